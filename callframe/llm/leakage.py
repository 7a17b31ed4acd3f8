"""Evaluation texts leaking into training text, by latent semantic retrieval.

1. Documents become word codes (64-bit hashes), written once; passages are windows of WINDOW
   words that start every STEP words, so any run of RUN words lies inside one passage.
2. Document frequencies of all passages are counted, over FEATURES hashed terms.
3. A randomised SVD of the matrix A of TF-IDF passages: Q = orthonormal basis of A'(A O) for a
   random O of RANK + OVERSAMPLE columns, then the small matrix (A Q)'(A Q), whose eigenvectors
   turn Q into the right singular vectors of A; the RANK with the largest singular values are
   the latent space. Both sums run over all passages of the corpus and those of the items, which
   get half of the weight so that the space holds them; partial sums meet in two levels,
   and their size does not depend on the corpus.
4. Candidates are pairs of a passage and an item one of whose passages has a cosine of at least
   COSINE with it in that space. Nothing else is looked at.
5. Candidates are checked: runs of RUN equal words, and for paraphrases the longest common
   subsequence and the words of the answer.

COSINE lies below what a run of RUN words among other words gives: of 21,570 planted runs the
lowest cosine was 0.376. `recall` counts what an exact search finds and the latent one does not.

Items are a stated query set. They are taken one block of ITEMS after the other, so what the
driver and a task hold is bounded; the space is common to all blocks, and a pair is judged by
itself, so the result does not depend on the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callframe.functions.staging import partitions, spread, stage
from callframe.functions.text import words

RUN = 12
WINDOW, STEP = 24, 13  # STEP <= WINDOW - RUN + 1
FEATURES, RANK, OVERSAMPLE = 1 << 15, 96, 16
COSINE = 0.30
#: Items whose runs and passages a task holds at once.
ITEMS = 5_000
#: Passages in one matrix product.
CHUNK = 1_000
SEED = 11
#: Least share of an item's words that a paraphrase has in order.
LCS_SHARE = 0.6
_BLOCKS = 32


def codes(text: str | None, known: dict[str, int]) -> np.ndarray:
    tokens = words(text)
    h = xxhash.xxh3_64_intdigest
    if len(known) > 1 << 20:
        known.clear()
    return np.fromiter((known[t] if t in known else known.setdefault(t, h(t)) for t in tokens), np.uint64, len(tokens))


def coded(documents: DataFrame) -> DataFrame:
    """(doc_id, codes binary) of documents with RUN words or more; the others (NULL and empty too) cannot leak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, out = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = codes(t, known)
                if len(c) >= RUN:
                    ids.append(d)
                    out.append(c.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "codes"])

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, "doc_id bigint, codes binary")


class Passages:
    """A chunk of passages: terms, where each passage begins, its document (index in the batch) and first word."""

    def __init__(self, docs: list[np.ndarray], owner: np.ndarray, start: np.ndarray) -> None:
        size = np.array([len(d) for d in docs])
        base = np.cumsum(size) - size
        self.length = np.minimum(start + WINDOW, size[owner]) - start
        self.words = np.concatenate(docs)
        self.terms = (self.words & np.uint64(FEATURES - 1)).astype(np.int64)
        self.first = base[owner] + start
        self.ptr = np.cumsum(self.length) - self.length
        self.row = np.repeat(np.arange(len(owner)), self.length)
        self.place = np.arange(self.length.sum()) - np.repeat(self.ptr - self.first, self.length)
        self.owner, self.start, self.n = owner, start, len(owner)

    def _unique(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (passage, term) pairs as one key, and how often each occurs."""
        return np.unique(self.row * FEATURES + self.terms[self.place], return_counts=True)

    def frequencies(self) -> np.ndarray:
        return np.bincount(self._unique()[0] % FEATURES, minlength=FEATURES)

    def weigh(self, idf: np.ndarray) -> None:
        key, count = self._unique()
        part = count * idf[key % FEATURES]
        self.norm = np.sqrt(np.bincount(key // FEATURES, weights=part * part, minlength=self.n)).astype(np.float32)[:, None]

    def project(self, scaled: np.ndarray) -> np.ndarray:
        """TF-IDF rows times a basis that was multiplied by idf; each word's row is fetched once, although passages overlap."""
        rows = np.concatenate([scaled[self.terms], np.zeros((1, scaled.shape[1]), scaled.dtype)])
        bounds = np.stack([self.first, self.first + self.length], axis=1).ravel()
        return np.add.reduceat(rows, bounds, axis=0)[::2] / self.norm

    def scatter(self, y: np.ndarray, into: np.ndarray) -> None:
        """into += A'y, to be multiplied by idf. Every other passage of a document overlaps with none of its kind."""
        y = y / self.norm
        z = np.zeros((len(self.words), y.shape[1]), y.dtype)
        odd = ((self.start // STEP) % 2 == 1)[self.row]
        z[self.place[~odd]] = y[self.row[~odd]]
        z[self.place[odd]] += y[self.row[odd]]
        order = np.argsort(self.terms, kind="stable")
        t = self.terms[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        into[t[first]] += np.add.reduceat(z[order], first, axis=0)


def passages(docs: list[np.ndarray]) -> Iterator[tuple[list[np.ndarray], Passages]]:
    """Chunks of the passages of some documents; a long document is cut over several chunks. Documents have RUN words or more."""
    at = 0
    while at < len(docs):
        end, n = at, 0
        while end < len(docs) and (n < CHUNK or end == at):
            n += max(1, -(-(len(docs[end]) - RUN + 1) // STEP))
            end += 1
        part = docs[at:end]
        starts = [np.arange(0, max(1, len(d) - RUN + 1), STEP) for d in part]
        owner, start = np.repeat(np.arange(len(part)), [len(s) for s in starts]), np.concatenate(starts)
        for i in range(0, len(owner), 2 * CHUNK):
            o, s = owner[i : i + 2 * CHUNK], start[i : i + 2 * CHUNK]
            low = o[0]
            yield part[low : o[-1] + 1], Passages([*part[low : o[-1] + 1]], o - low, s)
        at = end


def _decode(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _pieces(total: np.ndarray, part: int) -> pa.RecordBatch:
    flat = np.array_split(total, _BLOCKS)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(_BLOCKS), pa.int32()), pa.array([part] * _BLOCKS, pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())], names=["block", "part", "data"]
    )


def sum_matrices(partials: DataFrame, dtype: np.dtype, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of one matrix per task, given in _BLOCKS pieces; in two levels, so no task reads more than about the root of their number."""
    schema = "block int, part int, data binary"

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, dtype).astype(np.float64) for b in table.column("data").to_pylist())
        return pa.table({"block": table.column("block").slice(0, 1), "part": table.column("part").slice(0, 1), "data": pa.array([total.astype(dtype).tobytes()], pa.binary())})

    fan = max(1, int(partitions(partials) ** 0.5))
    first = partials.withColumn("part", (F.col("part") % fan).cast("int")).groupBy("block", "part").applyInArrow(add, schema)
    rows = sorted(first.groupBy("block").applyInArrow(add, schema).collect())
    if not rows:
        return np.zeros(shape, dtype)
    return np.concatenate([np.frombuffer(r["data"], dtype) for r in rows]).reshape(shape)


def _map_sum(coded_docs: DataFrame, made, dtype, shape: tuple[int, ...]) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(shape, dtype)
        for batch in batches:
            for _, p in passages(_decode(batch.column(0))):
                made(p, total)
        yield _pieces(total, TaskContext.get().partitionId())

    return sum_matrices(coded_docs.select("codes").mapInArrow(run, "block int, part int, data binary"), np.dtype(dtype), shape)


Item = tuple[int, np.ndarray, np.ndarray | None]


def item_blocks(items: DataFrame) -> Callable[[], Iterator[list[Item]]]:
    """A function that goes through [(item_id, codes, codes of the answer or None)] block by block; one block is on the driver at a time.

    Duplicates and NULL ids are dropped; a block has about ITEMS items.
    """
    has = "answer" in items.columns
    rows = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text", (F.col("answer") if has else F.lit(None)).cast("string").alias("answer")).distinct()
    blocks = max(1, -(-rows.count() // ITEMS))
    kept = stage(rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")), "items", by="block")

    def each() -> Iterator[list[Item]]:
        for b in range(blocks):
            known: dict[str, int] = {}
            some = sorted(kept.filter(F.col("block") == b).collect(), key=lambda r: (r["item_id"], r["text"] or "", r["answer"] or ""))
            yield [(r["item_id"], codes(r["text"], known), codes(r["answer"], known) if r["answer"] else None) for r in some]

    each.blocks = blocks
    return each


def places(a: np.ndarray) -> dict[int, int]:
    """Word -> bits of the positions where it stands in a."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    return at


def lcs(a: np.ndarray, b: np.ndarray, at: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, bit-parallel over the words of a, whose places may be given."""
    at = places(a) if at is None else at
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        if m := at.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _runs(c: np.ndarray) -> np.ndarray:
    """Code of each run of RUN words along the last axis."""
    n = max(0, c.shape[-1] - RUN + 1)
    out = np.zeros((*c.shape[:-1], n), np.uint64)
    for k in range(RUN if n else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + c[..., k : n + k]
    return out


class Space(NamedTuple):
    """Inverse document frequencies, the right singular vectors multiplied by them, and the least cosine of a candidate."""

    idf: np.ndarray
    scaled: np.ndarray
    cosine: float = COSINE


class Items:
    """What a task needs of a block of items: latent passages, runs, and the items themselves."""

    def __init__(self, block: list[Item], space: Space) -> None:
        self.items = block
        long = [(k, c) for k, (_, c, _) in enumerate(block) if len(c)]
        vectors, owners = [np.zeros((0, space.scaled.shape[1]), np.float32)], []
        for _, p in passages([c for _, c in long]):
            p.weigh(space.idf)
            vectors.append(p.project(space.scaled))
        for k, c in long:
            owners += [k] * len(np.arange(0, max(1, len(c) - RUN + 1), STEP))
        q = np.concatenate(vectors)
        self.latent = np.ascontiguousarray((q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)).T)
        self.owner = np.array(owners, np.int64)
        with np.errstate(over="ignore"):
            runs: dict[int, dict[bytes, set[int]]] = {}
            for k, (_, c, _) in enumerate(block):
                for i, r in enumerate(_runs(c).tolist()):
                    runs.setdefault(r, {}).setdefault(c[i : i + RUN].tobytes(), set()).add(k)
        self.runs = runs
        self.sorted_runs = np.array(sorted(runs), np.uint64)
        self.places: dict[int, dict[int, int]] = {}

    def has_run(self, runs: np.ndarray) -> np.ndarray:
        if not len(self.sorted_runs):
            return np.zeros(runs.shape, bool)
        place = np.searchsorted(self.sorted_runs, runs)
        return self.sorted_runs[np.minimum(place, len(self.sorted_runs) - 1)] == runs

    def lcs(self, k: int, near: np.ndarray) -> int:
        text = self.items[k][1]
        if k not in self.places:
            self.places[k] = places(text)
        return lcs(text, near, self.places[k])

    def near(self, p: Passages, space: Space) -> Iterator[tuple[int, int, float]]:
        """(passage, index of the item, cosine) of all pairs with a cosine of space.cosine or more, each once."""
        p.weigh(space.idf)
        d = p.project(space.scaled)
        cosine = (d @ self.latent) / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-9)
        row, column = np.nonzero(cosine >= space.cosine)
        if not len(row):
            return
        key = row * len(self.items) + self.owner[column]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        most = np.maximum.reduceat(cosine[row, column][order], first)
        key = key[first]
        yield from zip((key // len(self.items)).tolist(), (key % len(self.items)).tolist(), most.tolist())


FOUND = "doc_id bigint, item_id bigint, run boolean, cosine double, lcs_share double"
_FOUND_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64()]


def search(documents: DataFrame, items: DataFrame, paraphrases: bool = False, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, run, cosine, lcs_share): what the candidates of the latent search hold.

    run: document and item have RUN consecutive words in common. With paraphrases=True also
    pairs around whose candidate passages the longest common subsequence has LCS_SHARE of the item's
    words (and, where items have an `answer`, the words of the answer). Every candidate pair
    is checked. Pairs whose passages all stay below `cosine` are not found. Empty items and
    documents match nothing; a pair comes once.
    """
    spark: SparkSession = documents.sparkSession
    table = stage(coded(documents), "codes")
    blocks = item_blocks(items)
    space = latent_space(spark, table, blocks)._replace(cosine=cosine)
    shared = spark.sparkContext.broadcast(space)  # FEATURES x RANK, whatever the corpus
    found = None
    for block in blocks():
        mine = spark.sparkContext.broadcast(block)  # about ITEMS items

        def run(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            known = Items(mine.value, shared.value)
            for batch in batches:
                rows = _matches(batch.column(0).to_pylist(), _decode(batch.column(1)), known, shared.value, paraphrases)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND_TYPES)], names=["doc_id", "item_id", "run", "cosine", "lcs_share"])

        part = table.mapInArrow(run, FOUND)
        if blocks.blocks > 1:  # written before the next block comes to the driver
            part = stage(part, "found")
            mine.destroy()
        found = part if found is None else found.unionByName(part)
    # An item id that is given with several texts can be in a pair several times.
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"))


def recall(documents: DataFrame, items: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row (pairs, found, missed): pairs with a common run by an exact search for the runs' codes, and how many of them the latent search finds."""
    spark: SparkSession = documents.sparkSession
    table = stage(coded(documents), "codes")
    exact = None
    for block in item_blocks(items)():
        mine = spark.sparkContext.broadcast(block)  # about ITEMS items

        def run(batches: Iterator[pa.RecordBatch], mine=mine) -> Iterator[pa.RecordBatch]:
            none = Space(np.ones(FEATURES), np.zeros((FEATURES, 1), np.float32))
            known = Items(mine.value, none)
            for batch in batches:
                pairs: set[tuple[int, int]] = set()
                with np.errstate(over="ignore"):
                    for doc, c in zip(batch.column(0).to_pylist(), _decode(batch.column(1))):
                        runs = _runs(c)
                        for i in np.flatnonzero(known.has_run(runs)).tolist():
                            pairs |= {(doc, known.items[k][0]) for k in known.runs[int(runs[i])].get(c[i : i + RUN].tobytes(), ())}
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in pairs], pa.int64()) for j in (0, 1)], names=["doc_id", "item_id"])

        part = stage(table.mapInArrow(run, "doc_id bigint, item_id bigint"), "exact")
        mine.destroy()
        exact = part if exact is None else exact.unionByName(part)
    latent = search(documents, items, cosine=cosine).filter("run").select("doc_id", "item_id", F.lit(True).alias("hit"))
    both = exact.distinct().join(latent, ["doc_id", "item_id"], "left")
    return both.agg(F.count("*").alias("pairs"), F.count("hit").alias("found"), F.count_if(F.col("hit").isNull()).alias("missed"))


def _add_frequencies(p: Passages, total: np.ndarray) -> None:
    total[:-1] += p.frequencies()
    total[-1] += p.n


def latent_space(spark: SparkSession, table: DataFrame, blocks: Callable[[], Iterator[list[Item]]]) -> Space:
    """The RANK leading right singular vectors of the passages of the corpus and the items."""
    frequency = _map_sum(table, _add_frequencies, np.int64, (FEATURES + 1,))
    n, width = int(frequency[-1]), RANK + OVERSAMPLE
    idf = np.log((1.0 + n) / (1.0 + frequency[:-1])) + 1.0

    def total(scaled: np.ndarray, add, shape: tuple[int, int]) -> np.ndarray:
        """Sum of add(passages, their projections, sum) over the corpus, plus that of the items with as much weight."""
        given = spark.sparkContext.broadcast((idf, scaled))

        def made(p: Passages, into: np.ndarray) -> None:
            idf, scaled = given.value
            p.weigh(idf)
            add(p, p.project(scaled), into)

        corpus = _map_sum(table, made, np.float32, shape)
        given.destroy()
        own, count = np.zeros(shape, np.float32), 0
        for block in blocks():
            for _, p in passages([c for _, c, _ in block if len(c)]):
                p.weigh(idf)
                add(p, p.project(scaled), own)
                count += p.n
        return corpus.astype(np.float64) + (max(1.0, 0.5 * n / count) * own if count else 0)

    scale = idf[:, None]
    start = np.random.default_rng(SEED).standard_normal((FEATURES, width))
    reach = scale * total((scale * start).astype(np.float32), _scatter, (FEATURES, width))
    q = np.linalg.qr(reach)[0]
    gram = total((scale * q).astype(np.float32), _gram, (width, width))
    values, vectors = np.linalg.eigh(gram)
    lead = vectors[:, np.argsort(values)[::-1][:RANK]]
    return Space(idf, (scale * (q @ lead)).astype(np.float32))


def _scatter(p: Passages, y: np.ndarray, into: np.ndarray) -> None:
    p.scatter(y, into)


def _gram(p: Passages, y: np.ndarray, into: np.ndarray) -> None:
    into += y.T @ y


def _matches(ids: list, docs: list[np.ndarray], items: Items, space: Space, paraphrases: bool) -> list[tuple]:
    found: dict[tuple[int, int], tuple[bool, float, float | None]] = {}
    if not items.latent.shape[1]:
        return []
    at = 0
    with np.errstate(over="ignore"):
        for part, p in passages(docs):
            while docs[at] is not part[0]:
                at += 1
            near = [*items.near(p, space)]
            if not near:
                continue
            # Words of the candidate passages in rows; a short last passage is filled up with 0, whose runs are not looked at.
            rows = np.unique([k for k, _, _ in near])
            place = np.minimum(p.first[rows, None] + np.arange(WINDOW), len(p.words) - 1)
            inside = np.arange(WINDOW) < p.length[rows, None]
            grid = np.where(inside, p.words[place], np.uint64(0))
            runs = _runs(grid)
            hit = items.has_run(runs) & inside[:, RUN - 1 :]
            shared: set[tuple[int, int]] = set()
            for r, i in zip(*(x.tolist() for x in np.nonzero(hit))):
                shared |= {(int(rows[r]), j) for j in items.runs[int(runs[r, i])].get(grid[r, i : i + RUN].tobytes(), ())}
            for k, j, cosine in near:
                doc, start, (item, text, answer) = part[p.owner[k]], int(p.start[k]), items.items[j]
                share = None
                if paraphrases:
                    window = doc[max(0, start - len(text)) : start + WINDOW + len(text)]
                    got = items.lcs(j, window) / len(text)
                    share = got if got >= LCS_SHARE and (answer is None or np.isin(answer, window).all()) else None
                if (k, j) in shared or share is not None:
                    key = at + int(p.owner[k]), item
                    old = found.get(key, (False, -1.0, None))
                    found[key] = (old[0] or (k, j) in shared, max(old[1], cosine), share if old[2] is None else max(old[2], share or 0.0))
    return [(ids[key], item, *v) for (key, item), v in found.items()]
