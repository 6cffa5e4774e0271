"""N-gram Jaccard join with set-relation skipping: groups of documents that share at least 80 % of their shingles.

How: equal sets become one. Each set's shingles get one global order, rarest first, so that only shingles that other
sets have too, and that stand early enough in the order, are listed. A list's pairs are skipped by position: the first
shingle that two similar sets share leaves both enough shingles to reach the overlap they need. And a set's answers are
derived from those of a highly similar one: each list's most typical set (its hub) is compared with all, what links to a
common hub is in one group, and only pairs across groups that the overlaps with their hub allow are compared. All
comparisons are exact, on 64-bit hashes of shingles.

Cases: a null text, or one without words, has no shingles and is a group of its own; a text of fewer words than a
shingle is one shingle. A row without id links with nothing and has no group. Rows that repeat an id are one document
of several texts: its group joins all their groups. Texts of any length are read whole. An empty table gives an empty
table. Only id_col and text_col are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .batches import bounded, trimmed

WORDS, PERCENT = 5, 80
#: Shingles and documents of a chunk, in which a task packs its rows.
CHUNK_SHINGLES, CHUNK_DOCS = 1_000_000, 60_000
#: Different words whose hashes a worker remembers.
REMEMBERED = 100_000
#: Words of a bucket of shingle hashes, about, and listed places of a shingle in a bucket, at most, before it counts as very frequent.
BUCKET_WORDS, BUCKET_PLACES = 1_000_000, 4_000_000
#: Ids are broadcast up to this many rows of 8 bytes; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 200_000
FREQUENT = (1 << 31) - 1
SKETCH = ["_s0", "_s1", "_s2", "_s3"]
#: Blocks of a list: sizes of sets grow by this factor from class to class, places in the order by that one.
SIZE_STEP, PLACE_STEP = 1.25, 4


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's shingles."""
    parts = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not parts:
        return np.empty(0, np.uint64)
    word = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(word))
    many = len(word) - size + 1
    mixed = np.full(many, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ word[k : k + many]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _digest(shingle_set: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(shingle_set.tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def parity_sketch(shingle_set: np.ndarray) -> np.ndarray:
    """256 bits, as 4 long integers: whether an odd number of hashes falls on each. Two sketches differ in at most as many bits as the sets in members."""
    odd = np.bincount((shingle_set >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def needed(percent: int, total: int | np.ndarray):
    """Least overlap of two sets with `total` members together: 100 c >= percent (total - c)."""
    return -(-percent * total // (100 + percent))


def prefix_length(percent: int, n: np.ndarray) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


# -- frequencies and prefixes -------------------------------------------------

_PACKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
PACKED = "bucket long, chunk long, kind int, a binary, b binary, c binary"
COLD, HOT_NAMES, HOT_PLACES, TABLE = range(4)
#: Marks a document's row among those of lists, whose `typical` is positive.
DOCUMENT = -1.0


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal place together: those of sorted hashes compress so."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.uint64).reshape(-1)


def _pack_chunk(chunk: int, sets: list[np.ndarray], digests: list[tuple[int, int]], documents: list[tuple], bits: int, hot_from: int) -> Iterator[dict]:
    hashes = np.concatenate([np.empty(0, np.uint64), *sets])
    places = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    order = np.argsort(hashes, kind="stable")
    hashes, places = hashes[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
    counts = np.diff(np.append(first, len(hashes)))
    hot = np.repeat(counts >= hot_from, counts)
    passed = -1 - chunk  # a group of its own takes what only passes through to its chunk
    yield {"bucket": passed, "chunk": chunk, "kind": TABLE, "a": np.array(digests, np.int64).tobytes(), "b": np.array([len(s) for s in sets], np.int64).tobytes(), "c": np.array(documents, np.int64).tobytes()}
    shift = np.uint64(64 - bits)
    names = hashes[first[counts >= hot_from]]
    if hot.any():
        yield {"bucket": passed, "chunk": chunk, "kind": HOT_PLACES, "a": hashes[hot].tobytes(), "b": places[hot].tobytes(), "c": b""}
    for kind, values in ((COLD, hashes[~hot]), (HOT_NAMES, names)):
        bucket = (values >> shift).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(values)]):
            if hi > lo:
                yield {"bucket": int(bucket[lo]), "chunk": chunk, "kind": kind, "a": _planes(values[lo:hi]), "b": places[~hot][lo:hi].tobytes() if kind == COLD else b"", "c": b""}


def _count_bucket(table: pa.Table) -> pa.Table:
    """Of one bucket: the places of shingles that several sets of the corpus have, with their number, by chunk."""
    if not len(table) or table.column("bucket")[0].as_py() < 0:
        return table
    kinds = table.column("kind").to_numpy()
    chunks = table.column("chunk").to_numpy()
    a, b = table.column("a").to_pylist(), table.column("b").to_pylist()
    cold = np.flatnonzero(kinds == COLD)
    hashes = [_from_planes(a[i]) for i in cold]
    hot = np.unique(np.concatenate([_from_planes(a[i]) for i in np.flatnonzero(kinds == HOT_NAMES)] or [np.empty(0, np.uint64)]))
    made: list[dict] = []
    if hashes:
        places = np.concatenate([np.frombuffer(b[i], np.uint16) for i in cold])
        of = np.repeat(np.arange(len(cold)), [len(h) for h in hashes])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        every, places, of = every[order], places[order], of[order]
        counts = np.diff(np.append(np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])), len(every)))
        number = np.repeat(counts, counts)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, every), len(hot) - 1)
            number = np.where(hot[at] == every, FREQUENT, number)
        shared = number > 1
        every, places, of, number = every[shared], places[shared], of[shared], number[shared].astype(np.int32)
        order = np.argsort(of, kind="stable")
        of = of[order]
        cuts = np.flatnonzero(np.diff(of)) + 1
        made = [
            {"bucket": 0, "chunk": int(chunks[cold[of[lo]]]), "kind": COLD, "a": every[order[lo:hi]].tobytes(), "b": places[order[lo:hi]].tobytes(), "c": number[order[lo:hi]].tobytes()}
            for lo, hi in zip([0, *cuts], [*cuts, len(of)])
            if hi > lo
        ]
    return pa.Table.from_pylist(made, schema=_PACKED)


_LISTED = pa.schema([("shingle", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("typical", pa.float64())])
LISTED = "shingle long, d1 long, d2 long, n long, pos long, typical double"


def _list_chunk(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one chunk: each set's prefix shingles that others have, with their places in the global order, and a row for each document (typical: DOCUMENT, pos: its id)."""
        kinds = table.column("kind").to_pylist()
        a, b, c = (table.column(x).to_pylist() for x in "abc")
        at = kinds.index(TABLE)
        digests, n = np.frombuffer(a[at], np.int64).reshape(-1, 2), np.frombuffer(b[at], np.int64)
        known, ident, size, d1, d2 = np.frombuffer(c[at], np.int64).reshape(-1, 5).T.copy()
        none = np.zeros(len(known), np.int64)
        documents = pa.Table.from_arrays([pa.array(none), pa.array(d1), pa.array(d2), pa.array(size), pa.array(ident, mask=known == 0), pa.array(np.full(len(known), DOCUMENT))], schema=_LISTED)
        rows = [i for i, k in enumerate(kinds) if k in (COLD, HOT_PLACES)]
        if not rows:
            return documents
        shingle = np.concatenate([np.frombuffer(a[i], np.uint64) for i in rows])
        place = np.concatenate([np.frombuffer(b[i], np.uint16) for i in rows]).astype(np.int64)
        number = np.concatenate([np.frombuffer(c[i], np.int32) if kinds[i] == COLD else np.full(len(b[i]) // 2, FREQUENT, np.int32) for i in rows])
        order = np.lexsort((shingle, number, place))
        shingle, place, number = shingle[order], place[order], number[order]
        shared = np.bincount(place, minlength=len(n))
        starts = np.concatenate([[0], np.cumsum(shared)[:-1]])
        pos = np.arange(len(place)) - starts[place] + (n - shared)[place]
        weight = np.bincount(place, np.minimum(number, 1_000_000), len(n)) / np.maximum(n, 1)
        keep = pos < prefix_length(percent, n)[place]
        place = place[keep]
        found = pa.Table.from_arrays([pa.array(v) for v in (shingle[keep].view(np.int64), np.ascontiguousarray(digests[place, 0]), np.ascontiguousarray(digests[place, 1]), n[place], pos[keep], weight[place])], schema=_LISTED)
        return pa.concat_tables([documents, found])

    return run


def prefix_lists(docs: DataFrame, id_col: str, text_col: str, percent: int, passing: list[str]) -> tuple[DataFrame, DataFrame]:
    """_id, _n, _d1, _d2 of each document (size and digest of its set), and LISTED rows of all sets; both written.

    Texts are read and hashed once; hashes are shuffled once, in packed rows, and places of shared ones once more.
    """
    size = docs.agg(F.sum(F.length(f"`{text_col}`"))).first()[0] or 0
    words = size / 6
    bits = max(3, int(np.ceil(np.log2(max(1.0, words / BUCKET_WORDS)))))
    hot_from = int(min(256, max(2, BUCKET_PLACES / max(1.0, words / CHUNK_SHINGLES))))
    # buckets and chunks have about equal sizes, whatever the corpus: one partition for each, or for a few small ones
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, 1 << bits)
    rows = bounded(docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").alias("_text")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[tuple[int, int], np.ndarray] = {}
        documents: list[tuple] = []
        total = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            out = list(_pack_chunk(task << 24 | made, list(held.values()), list(held), documents, bits, hot_from))
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist(out[at : at + 64], schema=_PACKED)

        for batch in batches:
            for ident, text in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist()):
                own = shingles(text)
                digest = _digest(own)
                documents.append((ident is not None, ident or 0, len(own), *digest))
                if ident is not None and len(own) and digest not in held:
                    held[digest] = own
                    total += len(own)
                if total >= CHUNK_SHINGLES or len(held) >= CHUNK_DOCS or len(documents) >= 4 * CHUNK_DOCS:
                    yield from flushed()
                    held, documents, total, made = {}, [], 0, made + 1
        if documents:
            yield from flushed()

    packed = rows.mapInArrow(trimmed(pack), PACKED)
    shared = packed.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_count_bucket, PACKED)
    listed = shared.repartition(parts, "chunk").groupBy("chunk").applyInArrow(_list_chunk(percent), LISTED)
    listed = store.written(listed, "prefixes", passing=passing)
    documents = listed.where(F.col("typical") == DOCUMENT).select(F.col("pos").alias("_id"), F.col("n").alias("_n"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"))
    return store.written(documents, "sets"), listed.where(F.col("typical") != DOCUMENT)


# -- comparisons --------------------------------------------------------------


def _sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, passing: list[str] | None = None) -> DataFrame:
    """_d1, _d2, _set (packed hashes) and _s0 to _s3 (parity sketch) of the documents with these ids (column _rep); written."""
    small = ids.count() <= BROADCAST_ROWS
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_rep"), F.col(f"`{text_col}`").alias("_text")).join(F.broadcast(ids) if small else ids, "_rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("_text").to_pylist()]
            digests = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
            sketches = np.array([parity_sketch(s) for s in sets], np.int64).reshape(-1, 4)
            columns = [*digests.T, pa.array([s.tobytes() for s in sets], pa.binary()), *sketches.T]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names=["_d1", "_d2", "_set", *SKETCH])

    made = bounded(rows).mapInArrow(trimmed(run), "_d1 long, _d2 long, _set binary, " + ", ".join(f"{c} long" for c in SKETCH))
    return store.written(made.dropDuplicates(["_d1", "_d2"]), "compared-sets", passing=passing)


_EDGE = ["a1", "a2", "b1", "b2"]


def overlaps(pairs: DataFrame, sets: DataFrame, passing: list[str] | None = None) -> DataFrame:
    """pairs (_EDGE: two digests) with common, the size of their sets' intersection; written."""
    left = sets.select(F.col("_d1").alias("a1"), F.col("_d2").alias("a2"), F.col("_set").alias("_a"))
    right = sets.select(F.col("_d1").alias("b1"), F.col("_d2").alias("b2"), F.col("_set").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for x, y in zip(batch.column("_a").to_pylist(), batch.column("_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common.append(int((y[at] == x).sum()) if len(y) else 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _EDGE), pa.array(common, pa.int64())], names=[*_EDGE, "common"])

    joined = bounded(pairs.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select(*_EDGE, "_a", "_b"))
    return store.written(joined.mapInArrow(trimmed(run), "a1 long, a2 long, b1 long, b2 long, common long"), "overlaps", passing=passing)


def components(edges: DataFrame) -> DataFrame:
    """v, label: the smallest vertex that edges (x, y) reach from v, for every vertex with an edge; written.

    Each round takes the least label of all neighbours, then the label's own label, until nothing changes.
    """
    spark, passing = edges.sparkSession, []
    both = store.written(edges.select("x", "y").union(edges.select("y", "x")).where("x <> y").distinct(), "edges", passing=passing)
    old: list[str] = []
    labels = store.written(both.groupBy("x").agg(F.least("x", F.min("y")).alias("label")).withColumnRenamed("x", "v"), "labels", passing=old)
    while True:
        now: list[str] = []
        near = both.join(labels.withColumnRenamed("v", "y"), "y").groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("x", "v"), "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("further"))
        step = store.written(step.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels", passing=now)
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("v", "label")
        store.remove_all(spark, old)
        old = now
        if not changed:
            store.remove_all(spark, passing)
            return labels


def block_pairs(listed: DataFrame, percent: int) -> DataFrame:
    """Pairs across groups that share a list and that no bound rules out: _EDGE, n, m (sizes), x, y (groups).

    A list is cut into blocks by classes of set sizes and of places in the order. If i and j are the places of the first
    shingle that sets of n <= m members share, then needed(n + m) <= n - i and <= m - j: the first bounds m, and with m the
    second bounds j. So a set, by its size and place, looks into few blocks of its list, those of sets as large or larger,
    and passes the others by before any join. What it meets must also fit its hub's and the parity sketches' bounds: two
    sets share at most half of what their sizes exceed their sketches' differing bits by.
    """
    size_class = lambda n: f"cast(floor(ln({n}) / ln({SIZE_STEP})) as int)"
    place_class = lambda j: f"cast(floor(ln({j} + 1) / ln({PLACE_STEP})) as int)"
    least = lambda total: f"(({percent} * ({total}) + {99 + percent}) div {100 + percent})"
    most = f"((n - pos) * {100 + percent} div {percent} - n)"
    top = f"least({most}, cast(ceil(pow({SIZE_STEP}, c + 1)) as long) + 1)"
    place = f"({top} - {least(f'n + {top}')})"
    seen = f"if({most} < n, array(), flatten(transform(sequence({size_class('n')}, {size_class(most)}), c -> transform(if({place} < 0, array(), sequence(0, {place_class(place)})), q -> named_struct('c', c, 'q', q)))))"
    indexed = listed.selectExpr("*", f"{size_class('n')} as c", f"{place_class('pos')} as q").alias("b")
    asking = listed.selectExpr("*", f"explode({seen}) as block").selectExpr("*", "block.c as c", "block.q as q").alias("a")
    differ = " + ".join(f"bit_count(a.{s} ^ b.{s})" for s in SKETCH)
    of_both = least("a.n + b.n")
    met = asking.join(indexed, F.expr(f"""
        a.shingle = b.shingle and a.c = b.c and a.q = b.q and a.grp <> b.grp and (a.n < b.n or a.n = b.n and a.grp < b.grp)
        and a.pos + {of_both} <= a.n and b.pos + {of_both} <= b.n
        and least(a.with_hub, b.with_hub) + least(a.n - a.with_hub, b.n - b.with_hub) >= {of_both}
        and (a.n + b.n - ({differ})) div 2 >= {of_both}"""))
    return met.selectExpr("a.d1 as a1", "a.d2 as a2", "b.d1 as b1", "b.d2 as b2", "a.n as n", "b.n as m", "a.grp as x", "b.grp as y").distinct()


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row for each of docs: _id, n_shingles, component_id (the smallest id that links reach)."""
    passing: list[str] = []  # tables that are gone when the groups are known
    sets, listed = prefix_lists(docs, id_col, text_col, percent, passing)
    named = sets.where("_n > 0 and _id is not null")
    reps = store.written(named.groupBy("_d1", "_d2").agg(F.min("_id").alias("_rep")), "representatives")
    listed = listed.dropDuplicates(["shingle", "d1", "d2"])
    typical = F.struct("typical", "n", "d1", "d2")
    hubs = listed.groupBy("shingle").agg(F.max(typical).alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1")
    placed = listed.join(hubs.select("shingle", F.col("hub.d1").alias("h1"), F.col("hub.d2").alias("h2")), "shingle")
    placed = store.written(placed, "placed", passing=passing)

    star = placed.where("d1 <> h1 or d2 <> h2").select(F.col("d1").alias("a1"), F.col("d2").alias("a2"), F.col("h1").alias("b1"), F.col("h2").alias("b2"), "n").distinct()
    star = store.written(star, "star", passing=passing)
    sized = placed.select("d1", "d2", "n").distinct()
    involved = sized.join(reps, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))).select("_rep").distinct()
    shingle_sets = _sets_of(docs, involved, id_col, text_col, passing)
    hub_size = sized.select(F.col("d1").alias("b1"), F.col("d2").alias("b2"), F.col("n").alias("m"))
    known = overlaps(star.select(*_EDGE), shingle_sets, passing).join(star, _EDGE).join(hub_size, ["b1", "b2"])
    similar = F.expr(f"100 * common >= {percent} * (n + m - common)")

    rep = lambda side, name: reps.select(F.col("_d1").alias(f"{side}1"), F.col("_d2").alias(f"{side}2"), F.col("_rep").alias(name))
    links = known.where(similar).select(*_EDGE).join(rep("a", "x"), ["a1", "a2"]).join(rep("b", "y"), ["b1", "b2"]).select("x", "y")
    # rows that repeat an id bind its texts' sets
    repeated = named.groupBy("_id").agg(F.count_distinct("_d1", "_d2").alias("k")).where("k > 1").select("_id")
    bound = named.join(repeated, "_id").join(reps, ["_d1", "_d2"]).select(F.col("_id").alias("x"), F.col("_rep").alias("y"))
    labels = components(links.union(bound))

    here = placed.join(reps, (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2"))).join(labels, F.col("_rep") == F.col("v"), "left")
    here = here.join(known.select(F.col("a1").alias("d1"), F.col("a2").alias("d2"), F.col("b1").alias("h1"), F.col("b2").alias("h2"), "common"), ["d1", "d2", "h1", "h2"], "left")
    here = store.written(here.select("shingle", "d1", "d2", "n", "pos", F.coalesce("label", "_rep").alias("grp"), F.coalesce("common", "n").alias("with_hub")), "grouped", passing=passing)
    mixed = here.groupBy("shingle").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("shingle")
    here = here.join(mixed, "shingle", "left_semi").join(shingle_sets.select(F.col("_d1").alias("d1"), F.col("_d2").alias("d2"), *SKETCH), ["d1", "d2"])
    pairs = block_pairs(store.written(here, "lists", passing=passing), percent)
    pairs = store.written(pairs, "pairs", passing=passing)
    across = overlaps(pairs.select(*_EDGE), shingle_sets, passing).join(pairs, _EDGE).where(similar).select("x", "y")
    merged = components(across)
    store.remove_all(docs.sparkSession, passing)

    of_set = reps.join(labels, F.col("_rep") == F.col("v"), "left").select("_d1", "_d2", F.coalesce("label", "_rep").alias("grp"))
    of_set = of_set.join(merged.select(F.col("v").alias("grp"), F.col("label").alias("final")), "grp", "left").select("_d1", "_d2", F.coalesce("final", "grp").alias("component_id"))
    found = sets.join(of_set.withColumnsRenamed({"_d1": "_s1", "_d2": "_s2"}), (F.col("_d1") == F.col("_s1")) & (F.col("_d2") == F.col("_s2")) & (F.col("_n") > 0), "left")
    return found.select("_id", F.col("_n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar_groups(docs).withColumnRenamed("_id", "doc_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), h AS (
  SELECT doc_id, hash(g) AS g FROM s
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), r AS (
  SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.u
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.u) AS component_id
FROM documents d JOIN r ON r.v = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY ALL
"""
