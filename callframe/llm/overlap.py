"""Same or near-same records across splits.

Records with one set of words are one class. Classes that stand in train and classes that
stand in an evaluation split meet by keys, pairs that can't reach the threshold are dropped in the
join, the others are verified by their exact Jaccard similarity, and confirmed class pairs are
expanded to their members or counted by split and source without expanding them.

Sets of up to LONG words meet by the first words that they share, in one order of all words, rarest first. Two sets
that reach the threshold lack few of each other's words, so their first common words are among the
first of each; a key is the sequence of them, as long as it takes to be rare (INFO bits, DEEP words at most), and every set has a
key for each sequence it may begin with. That misses no pair, and templates that share their common
words alone do not meet. A row carries the words it skipped and a parity of all words, which bound the
common ones from above. A key of more than CROWDED pairs is cut by the sizes of both sets.

Longer sets meet in buckets of banded minwise hashes and are compared by one-bit sketches first. BANDS and ROWS miss
a pair at the threshold with probability 5e-6, the sketch with 1e-6. A bucket in which more
than HEAVY pairs would meet is not joined: its classes meet by prefix filtering instead (pairs that
reach the threshold share one of their rarest words), which is exact. Keys that many rows of both
sides share are cut into blocks on both sides, so no task sees more than BLOCK x BLOCK of them.

A train row whose key no evaluation class uses is dropped before the shuffle, by a bit field of
fixed size (a bit that two keys share only lets a row pass in vain).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callframe.functions.skew import lookup_join
from callframe.functions.staging import spread, stage
from callframe.functions.text import user_text, words

BANDS, ROWS = 32, 4
SKETCH_BITS, SKETCH_LEAST = 128, 94
THRESHOLD = (3, 4)  # intersection / union >= 3/4
HEAVY = 25_000_000
#: Rows of a key that one block holds, on either side.
BLOCK = 2_000
#: Words of the largest set that meets by its first words.
LONG = 108
#: Bits of information that make a key rare enough, and words of a key at most.
INFO, DEEP = 11.0, 3
#: Pairs of a key above which it is cut by sizes.
CROWDED = 1_000_000
#: Classes that word counts and crowded keys are estimated from. They decide the time only, not the result.
SOME = 1 << 15
#: Bits of the field of used buckets, so at most FIELD_BITS / 64 rows are broadcast.
FIELD_BITS = 1 << 24
#: Seed of the hash functions.
SEED = 20_240_601


def _hashers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    n = BANDS * ROWS + SKETCH_BITS
    return r.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(tokens: list[str], mult: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(band keys int64[BANDS], sketch int64[2]) of a set of words."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 256):  # bounded memory for very long texts
        x = h[i : i + 256, None] * mult[None, :] + add[None, :]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        low = np.minimum(low, x.min(axis=0))
    rows = low[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        keys = (keys ^ rows[:, k]) * np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(31)
    bits = np.packbits((low[BANDS * ROWS :] >> np.uint64(17) & np.uint64(1)).astype(np.uint8))
    return keys.view(np.int64), bits.view(np.int64)


def word_sets(samples: DataFrame) -> DataFrame:
    """(sample_id, line_number, cls binary(16), word_set): different words of the user text, sorted, joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [" ".join(sorted({*words(t)})) for t in batch.column(2).to_pylist()]
            cls = [hashlib.blake2b(s.encode(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls, pa.binary()), pa.array(sets, pa.string())], names=["sample_id", "line_number", "cls", "word_set"])

    rows = samples.filter(F.col("sample_id").isNotNull()).select("sample_id", F.col("line_number").cast("bigint"), user_text("messages").alias("text"))
    return spread(rows).mapInArrow(run, "sample_id string, line_number bigint, cls binary, word_set string")


def memberships(splits: DataFrame) -> DataFrame:
    """(sample_id, in_train, in_eval): NULL ids and splits are ignored, every split but train is an evaluation split."""
    train = F.col("split") == "train"
    rows = splits.filter(F.col("sample_id").isNotNull() & F.col("split").isNotNull())
    return rows.groupBy("sample_id").agg(F.max(train).alias("in_train"), F.max(~train).alias("in_eval"))


def _bands(classes: DataFrame) -> DataFrame:
    """(key, cls, n, in_train, s0, s1): one row per class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = _hashers()
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = batch.column(1).to_pylist()
                for at in range(0, len(sets), 2_000):
                    tokens = [s.split(" ") for s in sets[at : at + 2_000]]
                    made = [signature(t, mult, add) for t in tokens]
                    sketch = np.repeat(np.array([s for _, s in made]), BANDS, axis=0)
                    many = pa.array(np.repeat(np.arange(len(tokens)), BANDS))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([k for k, _ in made])),
                            batch.column(0).slice(at, len(tokens)).take(many),
                            pa.array(np.repeat([len(t) for t in tokens], BANDS), pa.int32()),
                            batch.column(2).slice(at, len(tokens)).take(many),
                            pa.array(sketch[:, 0]),
                            pa.array(sketch[:, 1]),
                        ],
                        names=["key", "cls", "n", "in_train", "s0", "s1"],
                    )

    return spread(classes.select("cls", "word_set", "in_train")).mapInArrow(run, "key bigint, cls binary, n int, in_train boolean, s0 bigint, s1 bigint")


def used_buckets(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose key may be a key of `others`: all that are, and of the rest those that share a bit with one."""
    bit = F.pmod("key", F.lit(FIELD_BITS))
    word, mask = F.shiftrightunsigned(bit, 6), F.expr(f"shiftleft(1L, CAST(pmod(key, {FIELD_BITS}) & 63 AS INT))")
    field = others.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    met = rows.withColumn("_word", word).join(F.broadcast(field), "_word")  # at most FIELD_BITS / 64 rows
    return met.filter(F.col("_bits").bitwiseAND(mask) != 0).drop("_word", "_bits")


def blocked_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Equi-join in which a key's rows are cut into blocks of about BLOCK on both sides; every pair of blocks is a join key of its own.

    Both sides have a column `cls` of their own name (`t_cls`, `e_cls`), which decides the block.
    """
    l, r = (d.groupBy(key).agg(F.count("*").alias(n)) for d, n in ((left, "_l"), (right, "_r")))
    large = l.join(r, key).filter(F.greatest("_l", "_r") > BLOCK).select(key, F.ceil(F.col("_l") / BLOCK).cast("int").alias("_l"), F.ceil(F.col("_r") / BLOCK).cast("int").alias("_r"))
    large = stage(large, "large-keys")
    if large.isEmpty():
        return left.join(right, key)

    def cut(d: DataFrame, by: str, own: str, mine: str, other: str, others: str) -> DataFrame:
        known = lookup_join(d, large, key, "left")
        one = F.pmod(F.xxhash64(by), F.coalesce(mine, F.lit(1))).cast("int")
        return known.withColumn(own, one).withColumn(others, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))).drop("_l", "_r")

    return cut(left, "t_cls", "_i", "_l", "_r", "_j").join(cut(right, "e_cls", "_j", "_r", "_l", "_i"), [key, "_i", "_j"]).drop("_i", "_j")


def _sized(a: Column, b: Column) -> Column:
    """Sizes that allow the threshold."""
    up, down = THRESHOLD
    return F.least(a, b) * down >= F.greatest(a, b) * up


def _side(rows: DataFrame, p: str) -> DataFrame:
    return rows.select("key", *[F.col(c).alias(f"{p}_{c}") for c in rows.columns if c not in ("key", "in_train")])


def _prefix_keys(classes: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, cls, n): the rarest words of each class, as many as prefix filtering needs; `seen` has the (key, count) of all words."""
    up, down = THRESHOLD
    split = classes.withColumn("words", F.split("word_set", " "))
    one = stage(split.select("cls", F.size("words").alias("n"), F.explode("words").alias("key")), "words")
    ordered = lookup_join(one, seen, "key").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("count", "key"))).alias("w"))
    need = F.col("n") - F.ceil(F.col("n") * up / down).cast("int") + 1
    return ordered.select("cls", "n", F.explode(F.slice("w", F.lit(1), need)).alias("w")).select("w.key", "cls", "n")


def _least(n: int | np.ndarray) -> int | np.ndarray:
    """Words that a set of n shares at least with a set that reaches the threshold."""
    up, down = THRESHOLD
    return -(-n * up // down)


def first_words(codes: np.ndarray, info: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, skipped, key) of every sequence that may be the first words that a set shares with a similar one.

    codes, info: a row for each set, its words in order and their bits of information; n: its size, at least DEEP.
    Whether a sequence ends depends on its words alone, so both sets of a pair end it at the same word.
    """
    room = n - _least(n)
    row, last, key, bits = np.arange(len(n)), np.full(len(n), -1), np.zeros(len(n), np.uint64), np.zeros(len(n))
    found = []
    for i in range(DEEP):
        choices = room[row] + i - last
        rep = np.repeat(np.arange(len(row)), choices)
        at = last[rep] + 1 + np.arange(len(rep)) - np.repeat(np.cumsum(choices) - choices, choices)
        row = row[rep]
        key = (key[rep] ^ codes[row, at]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        bits = bits[rep] + info[row, at]
        ends = (bits >= INFO) | (i == DEEP - 1)
        found.append((row[ends], at[ends] - i, key[ends]))
        row, last, key, bits = row[~ends], at[~ends], key[~ends], bits[~ends]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _counts(classes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words of n classes that alone are no rare key: at most 2^INFO times the mean size of a set."""
    words = classes.select(F.explode(F.split("word_set", " ")).alias("w")).groupBy(F.xxhash64("w").alias("h")).count()
    rows = sorted(tuple(r) for r in words.filter(F.col("count") > n * 2.0**-INFO).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint64)


def _first_keys(classes: DataFrame, counts: tuple[np.ndarray, np.ndarray], total: int) -> DataFrame:
    """(key, cls bigint, n, in_train, in_eval, skipped, parity): a row for each sequence of `first_words`; `counts` of `total` classes order the words."""
    known, count = counts
    schema = "key bigint, cls bigint, n smallint, in_train boolean, in_eval boolean, skipped smallint, parity bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            room = np.diff(batch.column(1).offsets.to_numpy())
            room = room - _least(room) + DEEP
            most = np.cumsum([math.comb(r, DEEP) for r in room.tolist()])  # sequences of any length are no more
            cuts = np.searchsorted(most, np.arange(0, most[-1] if len(most) else 0, 500_000))
            for start, end in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                part = batch.slice(start, end - start)
                lists = part.column(1)
                if start == end:
                    continue
                n = np.diff(lists.offsets.to_numpy())
                h = lists.flatten().to_numpy()
                parity = np.bitwise_xor.reduceat(np.uint64(1) << (h.view(np.uint64) & np.uint64(63)), np.cumsum(n) - n)
                often = np.zeros(len(h), np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    often = np.where(known[at] == h, count[at], np.uint64(0))
                # The count, then the hash: words that aren't counted come first.
                codes = np.full((len(n), n.max()), np.iinfo(np.uint64).max, np.uint64)
                codes[np.arange(n.max()) < n[:, None]] = often << np.uint64(43) | h.view(np.uint64) >> np.uint64(21)
                codes.sort(axis=1)
                with np.errstate(divide="ignore", over="ignore"):
                    row, skipped, key = first_words(codes, np.log2(total) - np.log2(codes >> np.uint64(43)), n)
                many = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        part.column(0).take(many),
                        pa.array(n[row].astype(np.int16)),
                        part.column(2).take(many),
                        part.column(3).take(many),
                        pa.array(skipped.astype(np.int16)),
                        pa.array(parity.view(np.int64)[row]),
                    ],
                    names=["key", "cls", "n", "in_train", "in_eval", "skipped", "parity"],
                )

    hashes = F.transform(F.split("word_set", " "), lambda w: F.xxhash64(w))
    return spread(classes.select(F.xxhash64("cls").alias("cls"), hashes.alias("h"), "in_train", "in_eval")).mapInArrow(run, schema)


def _by_sizes(rows: DataFrame, crowded: DataFrame, mine: str) -> DataFrame:
    """Rows whose key is crowded get a key for every size that a similar set may have, together with their own."""
    up, down = THRESHOLD
    # They share at most n - skipped words, so the sizes together are at most that much times (up + down) / up.
    low, high = F.ceil(F.col("n") * up / down).cast("int"), F.floor((F.col("n") - F.col("skipped")) * (up + down) / up).cast("int") - F.col("n")
    marked = rows.join(F.broadcast(crowded.withColumn("_cut", F.lit(True))), "key", "left")
    sizes = F.when(F.col("_cut").isNull(), F.array(F.lit(0))).when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    pair = ("n", "_size") if mine == "t" else ("_size", "n")
    cut = F.xxhash64("key", *[F.col(c).cast("int") for c in pair])
    return marked.withColumn("_size", F.explode(sizes)).withColumn("key", F.when(F.col("_cut"), cut).otherwise(F.col("key"))).drop("_cut", "_size")


def _short_pairs(classes: DataFrame) -> DataFrame:
    """(t_cls, e_cls) of pairs of sets of up to LONG words that may reach the threshold, as xxhash64 of their classes, staged.

    Sets of fewer than DEEP words have no similar set but themselves.
    """
    size = F.size(F.split("word_set", " "))
    short = classes.filter((F.col("in_train") | F.col("in_eval")) & (size >= DEEP) & (size <= LONG))
    one_of = max(1, classes.count() // SOME)
    some = stage(short.filter(F.pmod(F.xxhash64("cls"), F.lit(one_of)) == 0), "some")
    total = max(1, some.count())
    counts = _counts(some, total)
    e = stage(_first_keys(short.filter("in_eval"), counts, total), "eval-keys")
    t = used_buckets(_first_keys(short.filter("in_train AND NOT in_eval"), counts, total), e).unionByName(e.filter("in_train"))
    sizes = _first_keys(some, counts, total).groupBy("key").agg(F.count_if("in_train").alias("t"), F.count_if("in_eval").alias("e"))
    most = max(CROWDED / one_of**2, 16 * (one_of > 1))
    crowded = stage(sizes.filter(F.col("t") * F.col("e") > most).select("key"), "crowded-keys")  # at most the rows of SOME classes
    if not crowded.isEmpty():
        t, e = _by_sizes(t, crowded, "t"), _by_sizes(e, crowded, "e")
    t, e = (_side(d.drop("in_eval"), p) for d, p in ((t, "t"), (e, "e")))
    up, down = THRESHOLD
    n = F.col("t_n") + F.col("e_n")
    most_common = F.least(F.col("t_n") - F.col("t_skipped"), F.col("e_n") - F.col("e_skipped"), F.floor((n - F.bit_count(F.col("t_parity").bitwiseXOR(F.col("e_parity")))) / 2))
    near = (F.col("t_cls") != F.col("e_cls")) & (most_common * (up + down) >= n * up)
    return stage(t.join(e, "key").filter(near).select("t_cls", "e_cls").distinct(), "near-pairs")


def similar_classes(classes: DataFrame) -> DataFrame:
    """(t_cls, e_cls) of different classes, one in train and one in an evaluation split, that reach the threshold.

    classes: (cls, word_set, in_train, in_eval), unique by cls, no empty set.
    """
    near = _short_pairs(classes)
    used = used_buckets(classes.withColumn("key", F.xxhash64("cls")), near.select(F.explode(F.array("t_cls", "e_cls")).alias("key")))
    size = F.size(F.split("word_set", " "))
    sets = stage(used.select("key", "cls", F.col("word_set").alias("w"), size.alias("n"), "in_train", "in_eval"), "near-sets")
    t, e = (sets.filter(f).select(*[F.col(c).alias(f"{p}_{c}") for c in ("key", "cls", "w", "n")]) for f, p in (("in_train", "t"), ("in_eval", "e")))
    pairs = near.select(F.col("t_cls").alias("t_key"), F.col("e_cls").alias("e_key")).join(t, "t_key").join(e, "e_key")
    # Words travel as one string, an array of them takes three times its room.
    found = pairs.filter(_similar(F.split("t_w", " "), F.split("e_w", " "), F.col("t_n") + F.col("e_n"))).select("t_cls", "e_cls")
    long = classes.filter(size >= _least(LONG + 1))  # those that a set of more than LONG words may be similar to
    if long.filter(size > LONG).isEmpty():
        return found
    return found.unionByName(_long_pairs(long))


def _similar(t: Column, e: Column, n: Column) -> Column:
    """Whether two arrays of different words, n together, reach the threshold."""
    up, down = THRESHOLD
    return F.size(F.array_intersect(t, e)) * (up + down) >= n * up


def _long_pairs(classes: DataFrame) -> DataFrame:
    """(t_cls, e_cls) of the pairs of which one set or both have more than LONG words."""
    e = stage(_bands(classes.filter("in_eval")), "eval-bands")
    only = stage(used_buckets(_bands(classes.filter("in_train AND NOT in_eval")), e), "train-bands")
    t = only.unionByName(e.filter("in_train"))  # classes of both sides have their bands already
    sizes = t.groupBy("key").agg(F.count("*").alias("t")).join(e.groupBy("key").agg(F.count("*").alias("e")), "key")
    heavy = stage(sizes.filter(F.col("t") * F.col("e") > HEAVY).select("key"), "heavy")
    crowded = not heavy.isEmpty()
    light = lambda d: d.join(heavy, "key", "left_anti") if crowded else d
    near = F.bit_count(F.col("t_s0").bitwiseXOR(F.col("e_s0"))) + F.bit_count(F.col("t_s1").bitwiseXOR(F.col("e_s1"))) <= SKETCH_BITS - SKETCH_LEAST
    other = (F.col("t_cls") != F.col("e_cls")) & _sized(F.col("t_n"), F.col("e_n"))
    met = _side(light(t), "t").join(_side(light(e), "e"), "key").filter(other & near).select("t_cls", "e_cls")
    if crowded:
        inside = [lookup_join(d.select("key", "cls"), heavy, "key", counted=d).select("cls").distinct() for d in (t, e)]
        some = [stage(classes.join(i, "cls", "left_semi").select("cls", "word_set"), "crowded") for i in inside]
        both = some[0].unionByName(some[1]).distinct()
        seen = stage(both.select(F.explode(F.split("word_set", " ")).alias("key")).groupBy("key").count(), "word-counts")
        pt, pe = (stage(_side(_prefix_keys(d, seen), p), "prefix") for d, p in zip(some, "te"))
        met = met.unionByName(blocked_join(pt, pe, "key").filter(other).select("t_cls", "e_cls"))
    sets = classes.select("cls", F.split("word_set", " ").alias("w"))
    both = met.distinct().join(sets.select(F.col("cls").alias("t_cls"), F.col("w").alias("t_w")), "t_cls")
    both = both.join(sets.select(F.col("cls").alias("e_cls"), F.col("w").alias("e_w")), "e_cls")
    return both.filter(_similar(F.col("t_w"), F.col("e_w"), F.size("t_w") + F.size("e_w")) & (F.greatest(F.size("t_w"), F.size("e_w")) > LONG)).select("t_cls", "e_cls")


def class_pairs(samples: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (sample_id, cls, in_train, in_eval, empty) and the similar class pairs (t_cls, e_cls).

    Class pairs include (c, c) where c has members on both sides. Samples without words are
    members (`empty`) but have no pairs. A sample delivered several times counts once; ids of
    `splits` that have no sample are left out.
    """
    rows = stage(word_sets(samples), "word-sets")
    first = rows.groupBy("sample_id").agg(F.min(F.struct(F.coalesce("line_number", F.lit(1 << 62)).alias("n"), "cls")).alias("f"))
    none = F.unhex(F.lit(hashlib.blake2b(b"", digest_size=16).hexdigest()))
    members = stage(first.select("sample_id", "f.cls", (F.col("f.cls") == none).alias("empty")).join(memberships(splits), "sample_id"), "members")
    flags = members.filter("NOT empty").groupBy("cls").agg(F.max("in_train").alias("in_train"), F.max("in_eval").alias("in_eval"))
    sets = rows.groupBy("cls").agg(F.first("word_set").alias("word_set"))
    classes = stage(sets.join(flags, "cls"), "classes")
    same = classes.filter("in_train AND in_eval").select(F.col("cls").alias("t_cls"), F.col("cls").alias("e_cls"))
    return members, stage(similar_classes(classes).unionByName(same), "pairs")


def represented(members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership, links) with the smallest sample_id of a class as its name: (sample_id, class_id, in_train, in_eval) and (train_class, eval_class).

    Samples without words are classes of their own; one that stands on both sides links to itself.
    """
    name = members.filter("NOT empty").groupBy("cls").agg(F.min("sample_id").alias("class_id"))
    known = lookup_join(members, name, "cls", "left")
    membership = known.select("sample_id", F.when(F.col("empty"), F.col("sample_id")).otherwise(F.col("class_id")).alias("class_id"), "in_train", "in_eval")
    t, e = (name.select(F.col("cls").alias(c), F.col("class_id").alias(n)) for c, n in (("t_cls", "train_class"), ("e_cls", "eval_class")))
    links = pairs.join(t, "t_cls").join(e, "e_cls").select("train_class", "eval_class")
    alone = members.filter("empty AND in_train AND in_eval").select(F.col("sample_id").alias("train_class"), F.col("sample_id").alias("eval_class"))
    return membership, links.unionByName(alone)


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(left_id, right_id) of every pair of a train and an evaluation member of a class pair, the smaller id first.

    The members of a class are cut into blocks of about BLOCK on both sides, so a class that a third of
    all rows share is many blocks and no task expands more than one pair of them. A sample on
    both sides gives (id, id).
    """

    some = members.filter("NOT empty")
    sizes = some.groupBy("cls").agg(F.count_if("in_train").alias("t"), F.count_if("in_eval").alias("e")).filter(F.greatest("t", "e") > BLOCK)
    large = stage(sizes, "large-classes")
    blocks = not large.isEmpty()

    def side(flag: str, p: str, other: str) -> DataFrame:
        rows = some.filter(flag).select(F.col("cls").alias(f"{p}_cls"), F.col("sample_id").alias(f"{p}_id"), F.col(other).alias(f"{p}_both"))
        if not blocks:
            return rows
        n = large.select(F.col("cls").alias(f"{p}_cls"), F.ceil(F.greatest(F.col(p), F.lit(1)) / BLOCK).cast("int").alias("_n"))
        return lookup_join(rows, n, f"{p}_cls", "left").withColumn(f"{p}_block", F.pmod(F.xxhash64(f"{p}_id"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")

    cells, t_keys, e_keys = pairs, ["t_cls"], ["e_cls"]
    for p, keys in (("t", t_keys), ("e", e_keys)) if blocks else ():
        n = large.select(F.col("cls").alias(f"{p}_cls"), F.ceil(F.greatest(F.col(p), F.lit(1)) / BLOCK).cast("int").alias("_n"))
        cells = cells.join(n, f"{p}_cls", "left").withColumn(f"{p}_block", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
        keys.append(f"{p}_block")
    met = cells.join(side("in_eval", "e", "in_train"), e_keys).join(side("in_train", "t", "in_eval"), t_keys)
    # Two samples that are both on both sides meet twice.
    met = met.filter(~(F.col("t_both") & F.col("e_both")) | (F.col("t_id") <= F.col("e_id")))
    alone = members.filter("empty AND in_train AND in_eval").select(F.col("sample_id").alias("left_id"), F.col("sample_id").alias("right_id"))
    return met.select(F.least("t_id", "e_id").alias("left_id"), F.greatest("t_id", "e_id").alias("right_id")).unionByName(alone)


def report(samples: DataFrame, splits: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, leaked, links): samples of an evaluation split and source with a train partner, and their number of links.

    Links are counted from class sizes, pairs of samples are not made. A sample without words
    that stands on both sides has one link, to itself. The source is that of the sample's first
    delivery; NULL is a source of its own.
    """
    source = samples.filter(F.col("sample_id").isNotNull()).groupBy("sample_id").agg(F.min(F.struct(F.col("line_number"), "source")).alias("f")).select("sample_id", "f.source")
    evals = splits.filter((F.col("split") != "train") & F.col("sample_id").isNotNull()).select("sample_id", "split").distinct()
    mine = evals.join(members.filter("in_eval").select("sample_id", "empty", "in_train", F.col("cls").alias("e_cls")), "sample_id").join(source, "sample_id")
    trained = members.filter("in_train AND NOT empty").groupBy(F.col("cls").alias("t_cls")).agg(F.count("*").alias("n"))
    partners = pairs.join(trained, "t_cls").groupBy("e_cls").agg(F.sum("n").alias("n"))
    sized = mine.filter("NOT empty").groupBy("e_cls", "split", "source").agg(F.count("*").alias("members"))
    linked = sized.join(partners, "e_cls").select("split", "source", "members", "n")
    alone = mine.filter("empty AND in_train").groupBy("split", "source").agg(F.count("*").alias("members")).withColumn("n", F.lit(1).cast("bigint"))
    return linked.unionByName(alone).groupBy("split", "source").agg(F.sum("members").alias("leaked"), F.sum(F.col("members") * F.col("n")).alias("links"))
