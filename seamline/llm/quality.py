"""Quality rules: gradient-boosted trees over document statistics, scored from flat node arrays.

Cases: a null text has no words, so it fails the base rules. Rows are judged each by itself, also where their id
repeats another's or is null. Texts of any length are read whole. Labels that are null, or whose document is missing,
teach nothing; without two classes of labels the trees keep every document that passes the base rules. An empty table
gives an empty table. Output columns replace input columns of the same name; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded, mapped, trimmed

#: Labelled documents that the trees learn from, at most: those of the smallest hash of their id.
MAX_LABELLED = 6_000
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "alpha_share", "digit_share", "upper_share", "punct_share",
    "distinct_share", "top_word_share", "run_share", "words_a_line", "symbol_word_share",
]
#: The score must not rise with these.
FALLING = ["symbol_share", "dup_line_share", "repeat_share", "top_word_share", "run_share", "symbol_word_share"]

_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    """For each code point: 0 other, 1 letter, 2 capital letter, 3 digit, 4 symbol, 5 space, 6 other ASCII punctuation."""
    global _CLASSES
    if _CLASSES is None:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x20000):
            x = chr(c)
            table[c] = 4 if x in SYMBOLS else 5 if x in " \t\n\r\x0b\x0c" else 2 if x.isupper() else 1 if x.isalpha() else 3 if x.isdecimal() else 6 if 32 < c < 127 else 0
        _CLASSES = table
    return _CLASSES


def repeated_words(ids: np.ndarray, n: int = 5) -> int:
    """Words that stand in an n-word window which the text holds at least twice; exact, by ranks instead of hashes."""
    windows = len(ids) - n + 1
    if windows < 2:
        return 0
    codes, width = ids[:windows].astype(np.int64), int(ids.max()) + 1
    high = width
    for k in range(1, n):
        if high * width >= 1 << 62:
            _, codes = np.unique(codes, return_inverse=True)
            high = int(codes.max()) + 1
        codes, high = codes * width + ids[k : k + windows], high * width
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(windows, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    steps = np.zeros(len(ids) + 1, np.int32)
    at = np.flatnonzero(again)
    steps[at] += 1
    steps[at + n] -= 1
    return int((np.cumsum(steps[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """BASE counts and FEATURES of a text."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()  # of bytes: at the ASCII white space that the contract names
    n = len(words)
    if not n:
        return [0, 0, sum(map(raw.count, SYMBOLS.encode())) if raw else 0, 0, 0], [0.0] * len(FEATURES)
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    kinds = np.bincount(_classes()[points], minlength=7)
    chars = int(len(points) - kinds[5])
    symbols = int(kinds[4])
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    repeats = repeated_words(ids)
    counts = np.bincount(ids)
    letters = int(kinds[1] + kinds[2])
    symbol_words = sum(w[-1] in b"#*$%&|<>" for w in words) if symbols else 0
    features = [
        float(np.log1p(n)), chars / n, symbols / chars, dup_lines / max(1, len(lines)), repeats / n, letters / chars, int(kinds[3]) / chars, int(kinds[2]) / max(1, letters), int(kinds[6]) / chars,
        len(seen) / n, int(counts.max()) / n, float((ids[1:] == ids[:-1]).sum()) / n, n / max(1, len(lines)), symbol_words / n,
    ]
    return [n, chars, symbols, dup_lines, repeats], features


def base_failed(base: list[int]) -> bool:
    n_words, repeats = base[0], base[4]
    return n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth in node arrays: node i has children 2i+1 and 2i+2, leaves follow the inner nodes."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes)
    leaf: np.ndarray  # (trees, leaves)
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality of each row; all trees step down together."""
        inner = self.feature.shape[1]
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Second-order boosting of the logistic loss on quantile bins; FALLING features get non-increasing splits and bounded leaves."""
    falling = np.array([f in FALLING for f in FEATURES])
    inner, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 20.0)
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, "left") for e, column in zip(edges, x.T)], 1)
    share = float(y.mean())
    prior = float(np.log(share / (1 - share)))
    total = np.full(len(y), prior)
    out = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        low, high = {0: -np.inf}, {0: np.inf}
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            low[2 * i + 1] = low[2 * i + 2] = low[i]
            high[2 * i + 1] = high[2 * i + 2] = high[i]
            best = (1e-6, None)
            if len(rows) >= 2:
                gs, hs = g[rows].sum(), h[rows].sum()
                value = lambda a, b: np.clip(-a / (b + ridge), low[i], high[i])  # noqa: E731,B023
                gain = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
                whole = gain(gs, hs, value(gs, hs))
                for f in range(x.shape[1]):
                    if not len(edges[f]):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges[f]) + 1))[:-1]
                    vl, vr = value(gl, hl), value(gs - gl, hs - hl)
                    won = gain(gl, hl, vl) + gain(gs - gl, hs - hl, vr) - whole
                    won[(hl < least) | (hs - hl < least) | (falling[f] & (vr > vl))] = -1
                    if won.max(initial=-1) > best[0]:
                        k = int(won.argmax())
                        best = (float(won[k]), (f, k, float(vl[k]), float(vr[k])))
            if best[1]:
                f, k, vl, vr = best[1]
                out[0][t, i], out[1][t, i] = f, edges[f][k]
                if falling[f]:
                    low[2 * i + 1] = high[2 * i + 2] = (vl + vr) / 2
            node[rows] = 2 * i + 1 + (x[rows, out[0][t, i]] > out[1][t, i])
        for k in range(leaves):
            rows = node == inner + k
            raw = -g[rows].sum() / (h[rows].sum() + ridge)
            out[2][t, k] = rate * np.clip(raw, low[inner + k], high[inner + k])
        total += out[2][t, node - inner]
    return Trees(*out, prior)


def labelled_features(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, label_id_col: str, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of at most max_labelled labelled documents that pass the base rules."""
    ident = F.col(f"`{label_id_col}`").cast("long")
    sample = labels.select(ident.alias("_id"), F.col(f"`{label_col}`").cast("double").alias("_y")).where("_id is not null and _y is not null").orderBy(F.xxhash64("_id"), "_id", "_y").limit(max_labelled)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(sample), "_id").select(F.xxhash64("_id", "_text").alias("_hash"), "_text", "_y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, h = [], [], []
            for text, label, ident in zip(*(batch.column(c).to_pylist() for c in ("_text", "_y", "_hash"))):
                base, features = statistics(text)
                if not base_failed(base):
                    x.append(features)
                    y.append(label)
                    h.append(ident)
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": pa.array(y, pa.float64()), "h": pa.array(h, pa.int64())})

    # an id may stand in any number of documents; the bound holds for them too
    found = bounded(rows).mapInArrow(trimmed(run), "x array<double>, y double, h long")
    got = found.orderBy("h", "y").limit(max_labelled).select("x", "y").toArrow()
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort([*x.T, y])  # rows come in any order; sums of floats shall not depend on it
    return x[order], y[order]


def apply_rules(docs: DataFrame, trees: Trees, *, text_col: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """docs with BASE, base_failed, quality_score and kept."""
    added = [*((name, T.LongType()) for name in BASE), ("base_failed", T.BooleanType()), ("quality_score", T.DoubleType()), ("kept", T.BooleanType())]

    def make(texts: pa.Array) -> list[pa.Array]:
        stats = [statistics(text) for text in texts.to_pylist()]
        base = np.array([s[0] for s in stats], np.int64).reshape(len(stats), len(BASE))
        score = trees.score(np.array([s[1] for s in stats], float).reshape(len(stats), len(FEATURES)))
        failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > MAX_REPEAT_PERCENT * base[:, 0])
        return [pa.array(np.ascontiguousarray(m)) for m in (*base.T, failed, score, ~failed & (score >= threshold))]

    return mapped(docs, text_col, added, make, keep_source=keep_text)


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", max_labelled: int = MAX_LABELLED, keep_text: bool = True) -> DataFrame:
    """Fits trees on labelled documents and judges all; see apply_rules."""
    x, y = labelled_features(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, label_id_col=label_id_col, max_labelled=max_labelled)
    return apply_rules(docs, fit(x, y), text_col=text_col, keep_text=keep_text)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality_rules(docs, labels, keep_text=False)
    return judged.select("doc_id", *BASE, "base_failed", "kept", "quality_score")
