"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

Cases: a null text, or one without a letter, is `und` with score 0, and rejected. Rows are judged each by itself, also
where their id repeats another's or is null. Texts of any length are read whole. Rows without a language teach nothing;
where nothing teaches, every text is `und`. An empty table gives an empty table. Output columns replace input columns of
the same name; all others pass through.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .batches import bounded, mapped

UNKNOWN = "und"
#: Rows that calibrate scores, at most: those of the smallest hash of id and text, and no more than this share of all.
MAX_CALIBRATION, CALIBRATION_SHARE = 2_000, 0.1
#: Confidence below which a language is rejected is the share REJECT of calibration rows' confidences.
REJECT = 0.005
BITS = 21  # of a code point, so that three of them fit in 63 bits: hashes of trigrams are exact

_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Lower-case code point of each letter or mark, 32 for all else."""
    global _FOLD
    if _FOLD is None:
        table = np.full(0x110000, 32, np.int64)
        for c in range(0x32000):
            x = chr(c)
            if x.isalpha():
                table[c] = ord(x.lower()[0])
            elif 0x300 <= c < 0x370:
                table[c] = c
        _FOLD = table
    return _FOLD


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Different trigrams of the folded text, runs of others than letters being one space, and their counts."""
    points = _fold()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    padded = np.concatenate([[32], points, [32]])
    padded = padded[np.concatenate([[True], (padded[1:] != 32) | (padded[:-1] != 32)])]
    if len(padded) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes = np.sort((padded[:-2] << 2 * BITS) | (padded[1:-1] << BITS) | padded[2:])
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes)))


def added(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The union of sorted arrays with their counts' sums."""
    if not codes:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    every, back = np.unique(np.concatenate(codes), return_inverse=True)
    return every, np.bincount(back, np.concatenate(counts), len(every)).astype(np.int64)


class Models:
    """One model a language over common sorted arrays: log-probabilities of trigrams and bigrams, and back-off weights of contexts.

    P(c|ab) = max(n(abc)-D3, 0)/n(ab.) + D3*t(ab.)/n(ab.) * P(c|b); P(c|b) likewise from continuation counts, down to
    P(c) from continuation counts and a uniform share.
    """

    PARTS = ("tri", "tri_p", "ctx", "ctx_w", "bi", "bi_p", "mid", "mid_w", "uni", "uni_p", "base")

    def __init__(self, languages: list[str], parts: dict[str, np.ndarray]):
        self.languages, self.parts = languages, parts
        self.__dict__.update(parts)

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> "Models":
        """counts: each language's sorted trigram codes and their counts."""
        languages = sorted(counts)
        low = (1 << BITS) - 1
        spaces = {name: np.unique(np.concatenate([make(codes) for codes, _ in counts.values()] or [np.empty(0, np.int64)])) for name, make in (("tri", lambda c: c), ("ctx", lambda c: c >> BITS), ("bi", lambda c: c & ((1 << 2 * BITS) - 1)), ("mid", lambda c: (c >> BITS) & low), ("uni", lambda c: c & low))}
        parts: dict[str, np.ndarray] = dict(spaces)
        shape = lambda name: np.zeros((len(spaces[name]), len(languages)))
        tri_p, ctx_w, bi_p, mid_w, uni_p, base = shape("tri"), np.ones((len(spaces["ctx"]), len(languages))), shape("bi"), np.ones((len(spaces["mid"]), len(languages))), shape("uni"), np.zeros(len(languages))
        alphabet = max(2, len(spaces["uni"])) + 1
        for k, language in enumerate(languages):
            codes, n = counts[language]
            d3 = cls._discount(n)
            ctx, at = np.unique(codes >> BITS, return_inverse=True)
            n_ctx, t_ctx = np.bincount(at, n), np.bincount(at)
            tri_p[np.searchsorted(spaces["tri"], codes), k] = np.maximum(n - d3, 0) / n_ctx[at]
            ctx_w[np.searchsorted(spaces["ctx"], ctx), k] = d3 * t_ctx / n_ctx
            bi, n_bi = np.unique(codes & ((1 << 2 * BITS) - 1), return_counts=True)
            d2 = cls._discount(n_bi)
            mid, at = np.unique(bi >> BITS, return_inverse=True)
            n_mid, t_mid = np.bincount(at, n_bi), np.bincount(at)
            bi_p[np.searchsorted(spaces["bi"], bi), k] = np.maximum(n_bi - d2, 0) / n_mid[at]
            mid_w[np.searchsorted(spaces["mid"], mid), k] = d2 * t_mid / n_mid
            uni, n_uni = np.unique(bi & low, return_counts=True)
            d1 = cls._discount(n_uni)
            base[k] = d1 * len(uni) / n_uni.sum() / alphabet
            uni_p[np.searchsorted(spaces["uni"], uni), k] = np.maximum(n_uni - d1, 0) / n_uni.sum()
        parts |= {"tri_p": tri_p, "ctx_w": ctx_w, "bi_p": bi_p, "mid_w": mid_w, "uni_p": uni_p, "base": base}
        return cls(languages, parts)

    @staticmethod
    def _discount(n: np.ndarray) -> float:
        ones, twos = int((n == 1).sum()), int((n == 2).sum())
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    @staticmethod
    def _rows(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full((len(wanted), values.shape[1]), default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        out = np.asarray(values[at], float)
        out[keys[at] != wanted] = default
        return out

    def cross_entropy(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Nats a character of a text's trigrams under each language."""
        low = (1 << BITS) - 1
        p = self._rows(self.uni, self.uni_p, codes & low, 0.0) + self.base
        p = self._rows(self.bi, self.bi_p, codes & ((1 << 2 * BITS) - 1), 0.0) + self._rows(self.mid, self.mid_w, (codes >> BITS) & low, 1.0) * p
        p = self._rows(self.tri, self.tri_p, codes, 0.0) + self._rows(self.ctx, self.ctx_w, codes >> BITS, 1.0) * p
        return -(n @ np.log(np.maximum(p, 1e-300))) / n.sum()

    def save(self, files: store.Files) -> None:
        files.make()
        for name in self.PARTS:
            out = io.BytesIO()
            np.save(out, self.parts[name])
            with files.write(f"{name}.npy") as f:
                f.write(out.getvalue())

    @classmethod
    def load(cls, languages: list[str], files: store.Files) -> "Models":
        """Memory-mapped where the shared folder is mounted."""
        parts = {}
        for name in cls.PARTS:
            if files.local:
                parts[name] = np.load(f"{files.root}/{name}.npy", mmap_mode="r")
            else:
                with files.read(f"{name}.npy") as f:
                    parts[name] = np.load(io.BytesIO(f.read()))
        return cls(languages, parts)


_LOADED: dict[str, Models] = {}


class Identifier:
    """Fitted models in a shared folder, with the calibration of their scores."""

    def __init__(self, languages: list[str], folder: str | None, temperature: float = 1.0, reject_below: float = 0.0):
        self.languages, self.folder, self.temperature, self.reject_below = languages, folder, temperature, reject_below

    def models(self) -> Models:
        if self.folder not in _LOADED:
            _LOADED.clear()
            _LOADED[self.folder] = Models.load(self.languages, store.Files(self.folder))
        return _LOADED[self.folder]

    def entropies(self, text: str | None) -> np.ndarray | None:
        """None for a text without a letter."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return None
        codes, n = trigrams(text)
        return self.models().cross_entropy(codes, n) if len(codes) else None

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, confidence from 0 to 1, and whether calibration rejects it."""
        entropy = self.entropies(text)
        if entropy is None:
            return UNKNOWN, 0.0, True
        score = confidence(entropy, self.temperature)
        return self.languages[int(entropy.argmin())], score, score < self.reject_below


def confidence(entropy: np.ndarray, temperature: float) -> float:
    """Share of the best language after a softmax of length-normalised cross-entropies."""
    return float(1 / np.exp(-(entropy - entropy.min()) * temperature).sum())


def fit_identifier(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Identifier:
    """Models from all rows of docs with a language.

    A task sums trigrams of a language in sorted arrays and sends each once; the driver gets the summed table, whose
    size follows the languages' different trigrams and not the rows, and writes models that workers map into memory.
    The temperature maximises the likelihood of calibration rows (at most MAX_CALIBRATION) under models that were
    counted without them; the models that judge then count these rows too.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").cast("string").alias("_lang")).where("_lang is not null and _text is not null")
    known = known.select("_text", "_lang", F.xxhash64("_id", "_text").alias("_hash"))
    drawn = [r[0] for r in known.select("_hash").orderBy("_hash").limit(MAX_CALIBRATION).collect()]
    drawn = drawn[: int(min(MAX_CALIBRATION, CALIBRATION_SHARE * known.count()))]
    last = drawn[-1] if drawn else None
    apart = F.col("_hash") <= F.lit(last) if drawn else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            held: dict[tuple[str, bool], list] = {}
            for text, lang, out in zip(*(batch.column(c).to_pylist() for c in ("_text", "_lang", "_apart"))):
                held.setdefault((lang, out), []).append(trigrams(text))
            for key, found in held.items():
                found.append(total.get(key, (np.empty(0, np.int64),) * 2))
                total[key] = added([c for c, _ in found], [n for _, n in found])
        for (lang, out), (codes, n) in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "apart": pa.array([out] * len(codes), pa.bool_()), "code": pa.array(codes), "n": pa.array(n)})

    summed = bounded(known.select("_text", "_lang", apart.alias("_apart"))).mapInArrow(run, "lang string, apart boolean, code long, n long").groupBy("lang", "apart", "code").agg(F.sum("n").alias("n"))
    table = summed.toArrow()
    langs, codes, n = table.column("lang").to_numpy(), table.column("code").to_numpy(), table.column("n").to_numpy()
    out = table.column("apart").to_numpy()

    def counts(rows: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        return {lang: added([codes[rows & (langs == lang)]], [n[rows & (langs == lang)]]) for lang in sorted(set(langs[rows]))}

    if not len(langs):
        return Identifier([], None)
    models, folder = Models.fit(counts(np.ones(len(langs), bool))), store.scratch(spark, "language-models")
    models.save(store.Files(folder))
    if not drawn or out.all():
        return Identifier(models.languages, folder)
    without, apart_folder = Models.fit(counts(~out)), store.scratch(spark, "language-models")
    without.save(store.Files(apart_folder))
    plain = Identifier(without.languages, apart_folder)

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(e.tolist(), plain.languages.index(lang), h) for text, lang, h in zip(*(batch.column(c).to_pylist() for c in ("_text", "_lang", "_hash"))) if lang in plain.languages and (e := plain.entropies(text)) is not None]
            yield pa.RecordBatch.from_pydict({"e": pa.array([r[0] for r in rows], pa.list_(pa.float64())), "k": pa.array([r[1] for r in rows], pa.int64()), "h": pa.array([r[2] for r in rows], pa.int64())})

    # a row may stand in any number of copies; the bound holds for them too
    got = bounded(known.where(apart)).mapInArrow(entropies, "e array<double>, k long, h long").orderBy("h", "k").limit(MAX_CALIBRATION).select("e", "k").toArrow()
    truth = got.column("k").to_numpy()
    if not len(truth):
        return Identifier(models.languages, folder)
    e = np.array(got.column("e").to_pylist(), float)
    order = np.lexsort([*e.T, truth])
    e, truth = e[order], truth[order]
    e = e - e.min(1, keepdims=True)
    loss = lambda t: float((e[np.arange(len(e)), truth] * t + np.log(np.exp(-e * t).sum(1))).mean())
    temperature = min((float(t) for t in np.geomspace(0.5, 64, 43)), key=loss)
    scores = 1 / np.exp(-e * temperature).sum(1)
    return Identifier(models.languages, folder, temperature, float(np.quantile(scores, REJECT)))


def identify(docs: DataFrame, model: Identifier, *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score and rejected."""
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]

    def make(texts: pa.Array) -> list[pa.Array]:
        judged = [model.judge(text) for text in texts.to_pylist()]
        return [pa.array([j[i] for j in judged], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]

    return mapped(docs, text_col, added, make, keep_source=keep_text)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit_identifier(docs.where(~held_out))
    judged = identify(docs.select("doc_id", "text"), model, keep_text=False)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
