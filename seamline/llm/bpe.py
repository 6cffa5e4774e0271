"""Byte-level BPE encoding with a minimal acyclic transducer of frequent words, and decoding.

Cases: a null or empty text has no ids and decodes to an empty text. Rows are encoded each by itself, also where their
id repeats another's or is null. Texts of any length are encoded whole. Special tokens' strings become their ids. An
empty table gives an empty table (and a lexicon without words). Output columns replace input columns of the same name;
all others pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .batches import bounded, mapped

#: Words of the lexicon and bytes of each, at most; all others are merged exactly.
LEXICON_WORDS, WORD_BYTES = 65_536, 32
#: Counted or merged words that a worker holds at once; longer ones than so many characters are not held beyond their batch.
HELD_WORDS, HELD_CHARS = 200_000, 256
#: Counts of words that a worker holds at once, in columns.
HELD_ROWS = 1_000_000
#: Texts of a batch and about their bytes, at most: columns of words and ids take some ten times as much.
BATCH_ROWS, BATCH_BYTES = 6_000, 4 << 20
#: Fixed value: how a byte-level tokenizer of this kind cuts text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file; `pattern` cuts texts into words, as the file does."""

    def __init__(self, path: str, pattern: str = WORDS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        ids = spec["model"]["vocab"]
        raw = {token: bytes(map(chars.__getitem__, token)) for token in ids if all(c in chars for c in token)}
        self.of_byte = [0] * 256
        self.of_last = [0] * 256
        suffix = spec["model"].get("end_of_word_suffix") or ""
        for token, b in chars.items():
            self.of_byte[b], self.of_last[b] = ids[token], ids[token + suffix]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self._sorted_pairs = self._bytes = None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in ids.items():
            self.bytes_of[i] = raw.get(token, token.encode())
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.cut = regex.compile(pattern).findall
        if any(re.fullmatch("[^\\W\\d_]*[^\\w\\s]*", token) for token in self.special):
            raise ValueError("a special token that is letters with symbols behind them could stand within a plain word")
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The text's words; special tokens stand as they are. Plain words, with a mark behind them or not, need no pattern."""
        if text.isascii() and text:
            body, mark = (text[:-1], text[-1]) if text[-1] in ",.;:!?" else (text, "")
            if body.isalpha() or (body[:1] == " " and body[1:].isalpha()):
                return [body, mark] if mark else [body]
        for token in self.special:
            if token in text:
                break
        else:
            return self.cut(text)
        return list(chain.from_iterable([part] if part in self.special else self.cut(part) for part in self.at_special.split(text)))

    def merged(self, word: str) -> bytes:
        """Ids of one word: the leftmost pair of least rank is merged until none is left.

        A heap holds the pairs' ranks and places and a linked list the symbols, so that a word of n bytes takes
        O(n log n) steps; a heap entry whose pair is gone by now is passed over.
        """
        if word in self.special:
            return np.array([self.special[word]], "<u4").tobytes()
        raw = word.encode("utf-8", "replace")
        ids = [self.of_byte[b] for b in raw[:-1]] + [self.of_last[b] for b in raw[-1:]]
        many, merges = len(ids), self.merges
        after, before = list(range(1, many + 1)), list(range(-1, many - 1))
        heap = [(found[0], at, found[1]) for at, pair in enumerate(zip(ids, ids[1:])) if (found := merges.get(pair))]
        heapq.heapify(heap)
        while heap:
            rank, at, new = heapq.heappop(heap)
            right = after[at]
            if right >= many or ids[at] < 0 or (found := merges.get((ids[at], ids[right]))) is None or found[0] != rank:
                continue
            ids[at], ids[right] = new, -1
            after[at] = beyond = after[right]
            if beyond < many:
                before[beyond] = at
                if found := merges.get((new, ids[beyond])):
                    heapq.heappush(heap, (found[0], at, found[1]))
            if (left := before[at]) >= 0 and (found := merges.get((ids[left], new))):
                heapq.heappush(heap, (found[0], left, found[1]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def merge_many(self, words: list[str]) -> list[bytes]:
        """merged() of each word; words of like length are merged together, each its leftmost pair of least rank at a time."""
        raw = [w.encode("utf-8", "replace") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(words)
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            size = int(lengths[order[at]])
            width = max(4, size + 1 if size < 16 else size + size // 4)
            if size == 0 or width > 64:
                group = order[at : at + 1] if size == 0 else order[at:]
                for i in group:
                    out[i] = self.merged(words[i]) if size else b""
                at += len(group)
                continue
            to = min(int(np.searchsorted(lengths[order], width, "right")), at + 20_000)
            group = order[at:to]
            at = to
            ids, n = self._merge_matrix([raw[i] for i in group], lengths[group], width)
            flat = ids.astype("<u4")
            for row, i, k in zip(flat, group.tolist(), n.tolist()):
                out[i] = row[:k].tobytes()
        for i, word in enumerate(words):
            if word in self.special:
                out[i] = self.merged(word)
        return out

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self._sorted_pairs is None:
            keys = np.fromiter((a << 20 | b for a, b in self.merges), np.int64, len(self.merges))
            rank, new = (np.fromiter((v[k] for v in self.merges.values()), np.int64, len(self.merges)) for k in (0, 1))
            order = np.argsort(keys)
            self._sorted_pairs = keys[order], rank[order], new[order]
        return self._sorted_pairs

    def _merge_matrix(self, words: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        keys, rank, new = self._pairs()
        never = np.int64(1 << 40)

        def look(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """Places of pairs in keys, -1 for none."""
            key = left << 20 | right
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where((keys[place] == key) & (left >= 0) & (right >= 0), place, -1)

        letters = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
        columns = np.arange(width)
        ids = np.array(self.of_byte, np.int64)[letters]
        last = np.array(self.of_last, np.int64)[letters]
        ids = np.where(columns == (lengths - 1)[:, None], last, ids)
        ids[columns >= lengths[:, None]] = -1
        places = np.full((len(words), width), -1, np.int64)
        places[:, :-1] = look(ids[:, :-1], ids[:, 1:])
        ranks = np.where(places >= 0, rank[places], never)
        n = lengths.copy()
        rows = np.arange(len(words))
        while True:
            best = ranks[rows].argmin(1)
            going = ranks[rows, best] < never
            rows, best = rows[going], best[going]
            if not len(rows):
                return ids, n
            merged = new[places[rows, best]]
            source = np.minimum(columns + (columns > best[:, None]), width - 1)
            moved = np.take_along_axis(ids[rows], source, 1)
            moved[:, -1] = -1
            k = np.arange(len(rows))
            moved[k, best] = merged
            spots = np.take_along_axis(places[rows], source, 1)
            spots[:, -1] = -1
            spots[k, best] = look(merged, np.where(best + 1 < width, moved[k, np.minimum(best + 1, width - 1)], -1))
            before = best > 0
            spots[k[before], best[before] - 1] = look(moved[k[before], best[before] - 1], merged[before])
            ids[rows], places[rows] = moved, spots
            ranks[rows] = np.where(spots >= 0, rank[spots], never)
            n[rows] -= 1

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of ids[bounds[k]:bounds[k + 1]] for each k."""
        if self._bytes is None:
            self._bytes = pa.array(self.bytes_of, pa.large_binary())
        taken = self._bytes.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)[bounds].tolist() if len(ids) else [0] * len(bounds)
        data = memoryview(taken.buffers()[2] or b"")
        return [bytes(data[lo:hi]) for lo, hi in zip(ends, ends[1:])]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids."""
        values = np.frombuffer(ids, "<u4")
        return self.decoded(values, np.array([0, len(values)]))[0].decode("utf-8", "replace")


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


#: Texts whose words may cross cuts before spaces and around line feeds: those with other white space, two characters
#: of it in a row, or any at an end, or the mark that cuts.
UNEVEN = r"[ \n][ \n]|\A[ \n]|[ \n]\z|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def blocks(texts: pa.Array) -> pa.ListArray:
    """Each of these even texts, cut before each space and around each line feed."""
    return pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")


def laid_out(codes: np.ndarray, table: list[bytes], offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids (little-endian 32-bit integers) of table[code] for all codes in a row, and where those of codes[offset] begin."""
    lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
    starts = np.cumsum(lengths) - lengths
    each = lengths[codes]
    ends = np.concatenate([[0], np.cumsum(each)])
    at = np.repeat(starts[codes] - ends[:-1], each)
    at += np.arange(len(at))
    return np.frombuffer(b"".join(table), "<u4")[at], ends[offsets]


#: Letters, and characters that are neither letters nor numbers nor white space, among the first 592; those that change
#: their number when folded are left out.
LETTERS = r"A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}"
SYMBOLS = r"!-/:-@\[-`{-~\x{a1}-\x{a9}\x{ab}\x{ac}\x{ae}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}\x{d7}\x{f7}"
#: Such letters with symbols behind them are two words to the tokenizers' patterns, so no pattern needs to cut them.
PLAIN, PLAIN_SPACED = (rf"\A(?P<a>{start})(?P<b>[{SYMBOLS}]*)\z" for start in (f"[{LETTERS}]*", f" ?[{LETTERS}]+"))


def ids_by_parts(split: pa.ListArray, plain: str, cut: Callable[[str], list[str]], ids_of: Callable[[list[str]], dict[str, bytes]], *, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """laid_out() of lists of blocks: different blocks are cut once (plain ones in two, by columns), and their different parts looked up once."""
    coded = split.values.dictionary_encode()
    parts = pc.extract_regex(coded.dictionary, plain)
    left, right = (pc.fill_null(parts.field(name), "") for name in "ab")
    two = pa.concat_arrays([pc.utf8_lower(left) if fold else left, right]).dictionary_encode()
    words = two.dictionary.to_pylist()
    rest = list(map(cut, coded.dictionary.filter(parts.is_null()).to_pylist()))
    ids = ids_of(list(dict.fromkeys(chain(words, chain.from_iterable(rest)))))
    table = [ids[w] for w in words] + [b"".join([ids[w] for w in ws]) for ws in rest] + [b""]
    pair = two.indices.to_numpy().reshape(2, -1).T.copy()
    uncut = parts.is_null().to_numpy(zero_copy_only=False)
    pair[uncut, 0] = len(words) + np.arange(len(rest))
    pair[uncut, 1] = len(table) - 1
    return laid_out(pair[coded.indices.to_numpy()].ravel(), table, 2 * split.offsets.to_numpy())


# -- lexicon ------------------------------------------------------------------


class Transducer:
    """Minimal acyclic automaton over bytes; the outputs along a word's path add up to its number, ids[starts[number]:...] are its ids."""

    PARTS = ("keys", "targets", "outputs", "final", "starts", "ids")

    def __init__(self, parts: dict[str, np.ndarray]):
        self.parts = parts
        self.__dict__.update(parts)

    @classmethod
    def build(cls, entries: Iterable[tuple[bytes, bytes]]) -> "Transducer":
        """entries: (word, ids) in the words' byte order, no word twice."""
        nodes: list[list] = [[False, {}]]  # final, byte -> node, on the path of the last word
        register: dict[tuple, int] = {}
        states: list[tuple] = []

        def close(down_to: int) -> None:
            while len(nodes) > down_to:
                final, edges = nodes.pop()
                shape = (final, tuple(edges.items()))
                state = register.get(shape)
                if state is None:
                    state = register[shape] = len(states)
                    states.append(shape)
                if nodes:
                    edge = next(reversed(nodes[-1][1]))
                    nodes[-1][1][edge] = state
                else:
                    nodes.append([final, edges])
                    return

        last, ids = b"", []
        for word, output in entries:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            close(common + 1)
            for b in word[common:]:
                nodes[-1][1][b] = -1
                nodes.append([False, {}])
            nodes[-1][0] = True
            last = word
            ids.append(np.frombuffer(output, "<u4"))
        close(1)
        final, edges = nodes[0]
        states.append((final, tuple(edges.items())))
        below: list[int] = []
        keys, targets, outputs = [], [], []
        for state, (final, edges) in enumerate(states):
            passed = int(final)
            for b, target in edges:
                keys.append(state << 8 | b)
                targets.append(target)
                outputs.append(passed)
                passed += below[target]
            below.append(passed)
        starts = np.cumsum([0, *map(len, ids)])
        return cls({"keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "outputs": np.array(outputs, np.int32), "final": np.array([f for f, _ in states], bool), "starts": starts.astype(np.int64), "ids": np.concatenate(ids).astype("<u4") if ids else np.empty(0, "<u4")})

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, -1 for words that it doesn't have; all words step together."""
        found = np.full(len(words), -1, np.int64)
        if not words or not len(self.keys):
            return found
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        rows = np.flatnonzero((lengths > 0) & (lengths <= WORD_BYTES))
        letters = np.array([words[i] for i in rows], f"S{WORD_BYTES}").view(np.uint8).reshape(len(rows), WORD_BYTES)
        state, number = np.full(len(rows), len(self.final) - 1, np.int64), np.zeros(len(rows), np.int64)
        at = np.arange(len(rows))
        for step in range(WORD_BYTES):
            done = lengths[rows[at]] == step
            ended = at[done & self.final[state]]
            found[rows[ended]] = number[ended]
            at, state = at[~done], state[~done]
            if not len(at):
                break
            key = state << 8 | letters[at, step]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[edge] == key
            at, edge = at[there], edge[there]
            number[at] += self.outputs[edge]
            state = self.targets[edge].astype(np.int64)
        else:
            ended = at[(lengths[rows[at]] == WORD_BYTES) & self.final[state]]
            found[rows[ended]] = number[ended]
        return found

    def save(self, files: store.Files) -> None:
        files.make()
        for name in self.PARTS:
            with files.write(f"{name}.npy") as f:
                np.save(f, self.parts[name]) if files.local else f.write(_npy(self.parts[name]))

    @classmethod
    def load(cls, files: store.Files) -> "Transducer":
        """Memory-mapped where the shared folder is mounted."""
        if files.local:
            return cls({name: np.load(f"{files.root}/{name}.npy", mmap_mode="r") for name in cls.PARTS})
        parts = {}
        for name in cls.PARTS:
            with files.read(f"{name}.npy") as f:
                parts[name] = np.load(io.BytesIO(f.read()))
        return cls(parts)


def _npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def count_words(docs: DataFrame, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """word, n over all texts; a task adds up about HELD_ROWS rows of (word, n) before it sends them on."""
    rows = bounded(docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text")), BATCH_ROWS, BATCH_BYTES)
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def counted(texts: pa.Array) -> pa.Table:
        """Plain blocks are cut by columns, all others one by one."""
        cut = vocabulary(tokenizer).words
        uneven = pc.match_substring_regex(texts, UNEVEN)
        others: Counter = Counter(chain.from_iterable(map(cut, texts.filter(uneven).to_pylist())))
        found = blocks(texts.filter(pc.invert(uneven))).flatten().value_counts()
        block, n = found.field(0), found.field(1)
        parts = pc.extract_regex(block, PLAIN_SPACED)
        odd = parts.is_null()
        for word, times in zip(block.filter(odd).to_pylist(), n.filter(odd).to_pylist()):
            for w in cut(word):
                others[w] += times
        plain, times = parts.drop_null(), n.filter(parts.is_valid())
        marked = pc.not_equal(plain.field("b"), "")
        words = [plain.field("a"), plain.field("b").filter(marked), pa.array(list(others), pa.string())]
        return pa.table([pa.chunked_array(words), pa.chunked_array([times, times.filter(marked), pa.array(list(others.values()), pa.int64())])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = schema.empty_table()
        for batch in batches:
            held = pa.concat_tables([held, counted(batch.column("_text"))])
            if held.num_rows > HELD_ROWS:
                held = held.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if held.num_rows > HELD_ROWS // 2:
                    yield from held.to_batches(max_chunksize=HELD_WORDS)
                    held = schema.empty_table()
        yield from held.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches(max_chunksize=HELD_WORDS)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, *, text_col: str = "text", max_words: int = LEXICON_WORDS) -> str:
    """Compiles the most frequent words of all texts, at most max_words; returns the shared folder that holds the automaton."""
    spark = docs.sparkSession
    passing: list[str] = []
    counted = store.written(count_words(docs, tokenizer, text_col=text_col).where((F.octet_length("word") <= WORD_BYTES) & (F.col("n") > 1)), "word-counts", passing=passing)
    eighths = F.floor(8 * F.log2("n")).cast("int")  # some hundred different values at most
    least, room = None, max_words
    for eighth, many in sorted(counted.groupBy(eighths.alias("eighth")).count().collect(), reverse=True):
        room -= many
        if room < 0:
            break
        least = eighth
    frequent = [] if least is None else [r.word for r in counted.where(eighths >= least).select("word").collect()]
    store.remove_all(spark, passing)
    vocab = vocabulary(tokenizer)
    words = [w for w in frequent if w not in vocab.special]
    entries = sorted(zip(map(str.encode, words), vocab.merge_many(words)))
    path = store.scratch(spark, "bpe-lexicon")
    Transducer.build(entries).save(store.Files(path))
    return path


class Encoder:
    """Encodes batches of texts: different words once, by the lexicon or, if it lacks them, by exact merges."""

    def __init__(self, tokenizer: str, lexicon: str):
        self.vocab, self.lexicon = vocabulary(tokenizer), Transducer.load(store.Files(lexicon))
        # views of the mapped file, not copies of it
        self.ids, self.starts = memoryview(np.asarray(self.lexicon.ids)).cast("B"), np.asarray(self.lexicon.starts)
        self.merged: dict[str, bytes] = {}

    def _of_words(self, words: list[str]) -> dict[str, bytes]:
        table = {w: self.merged[w] for w in words if w in self.merged}
        new = [w for w in words if w not in table]
        numbers = self.lexicon.numbers([w.encode("utf-8", "replace") for w in new])
        unseen = [w for w, k in zip(new, numbers.tolist()) if k < 0]
        if len(numbers) > len(unseen):
            known = np.maximum(numbers, 0)
            lows, highs, ids = (4 * self.starts[known]).tolist(), (4 * self.starts[known + 1]).tolist(), self.ids
            table.update((w, ids[lo:hi]) for w, k, lo, hi in zip(new, numbers.tolist(), lows, highs) if k >= 0)
        made = dict(zip(unseen, self.vocab.merge_many(unseen)))
        table.update(made)
        if len(self.merged) + len(made) > HELD_WORDS:
            self.merged.clear()
        self.merged.update((w, m) for w, m in made.items() if len(w) <= HELD_CHARS)
        return table

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return ids_by_parts(blocks(texts), PLAIN_SPACED, self.vocab.words, self._of_words)

    def _uneven(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = list(map(self.vocab.words, texts))
        place = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        words = self._of_words(list(place))
        codes = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64)
        return laid_out(codes, [words[w] for w in place], np.cumsum([0, *map(len, split)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin, with the end."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        uneven = pc.match_substring_regex(texts, UNEVEN)
        if not len(texts) or not pc.any(uneven).as_py():
            return self._even(texts)
        of = uneven.to_numpy(zero_copy_only=False)
        parts = [self._even(texts.filter(pc.invert(uneven))), self._uneven(texts.filter(uneven).to_pylist())]
        nth = np.where(of, np.cumsum(of), np.cumsum(~of)) - 1
        slices = [parts[side][0][parts[side][1][k] : parts[side][1][k + 1]] for side, k in zip(of.astype(int).tolist(), nth.tolist())]
        return np.concatenate(slices), np.cumsum([0, *map(len, slices)])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(tokenizer: str, lexicon: str) -> Encoder:
    if (tokenizer, lexicon) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[tokenizer, lexicon] = Encoder(tokenizer, lexicon)
    return _ENCODERS[tokenizer, lexicon]


def encode(docs: DataFrame, tokenizer: str, lexicon: str, *, text_col: str = "text") -> DataFrame:
    """docs with ids, an array of integers."""

    def make(texts: pa.Array) -> list[pa.Array]:
        ids, bounds = encoder(tokenizer, lexicon).encode(texts)
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))]

    return mapped(docs, text_col, [("ids", T.ArrayType(T.IntegerType()))], make, batch_rows=BATCH_ROWS, batch_bytes=BATCH_BYTES)


def decode(encoded: DataFrame, tokenizer: str, *, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded_text; null ids are none."""

    def make(ids: pa.Array) -> list[pa.Array]:
        lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        raw = vocabulary(tokenizer).decoded(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)]))
        return [pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())]

    return mapped(encoded, ids_col, [("decoded_text", T.StringType())], make)


def round_trip_digests(docs: DataFrame, tokenizer: str, lexicon: str, *, text_col: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 and decoded_sha256: encode, then decode, in one pass."""

    def make(texts: pa.Array) -> list[pa.Array]:
        ids, bounds = encoder(tokenizer, lexicon).encode(texts)
        raw, at = memoryview(np.ascontiguousarray(ids)).cast("B") if len(ids) else memoryview(b""), (4 * bounds).tolist()
        digest = lambda b: hashlib.sha256(b).hexdigest()
        decoded = [digest(d.decode("utf-8", "replace").encode()) for d in vocabulary(tokenizer).decoded(ids, bounds)]
        return [pa.array(np.diff(bounds)), pa.array([digest(raw[lo:hi]) for lo, hi in zip(at, at[1:])], pa.string()), pa.array(decoded, pa.string())]

    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return mapped(docs, text_col, kinds, make, keep_source=False, batch_rows=BATCH_ROWS, batch_bytes=BATCH_BYTES)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    lexicon = build_lexicon(docs, tokenizer)
    return round_trip_digests(docs, tokenizer, lexicon).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
