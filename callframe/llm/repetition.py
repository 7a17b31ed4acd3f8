"""Repetition inside a single document: compression bands, then the exact share.

The words of a document are written as 4-byte codes, which no entropy coder can shorten, so
that zstandard gains only where two or more earlier words are repeated. The ratio is taken
over the whole document and over fixed chunks, and a third one over the raw bytes. Bands
with limits by length set apart repetitive text (a code ratio is high) and incompressible
text (the raw ratio is low). Only documents of the repetitive band are measured exactly:
1 - (different / all runs of five consecutive words).

Why the band loses nothing: let a share s of the word runs be repeats. Then at least s of the
words repeat earlier text in matches of five words (20 bytes) or more, and a match is written
in a few bytes. So the compressed size is at most (1 - s) of the raw one plus a few bytes a
match and the frame. `limit` is that bound. The match finder must be near exhaustive and its
window must hold the document, which LEVEL and the window setting see to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callframe.functions.staging import spread
from callframe.functions.text import words

RUN = 5
LEAST_WORDS = 20
SHARE = 0.30
CHUNK_WORDS = 512
#: Bytes of a frame and of one match in the worst case, for the limits.
FRAME_BYTES, MATCH_BYTES = 24, 7
#: Words up to which the compressor's tables keep every position of a text; longer texts are measured without asking it.
TABLE_WORDS = 1 << 20
SCORES = "doc_id bigint, n_words bigint, ratio double, chunk_ratio double, raw_ratio double, band string, share double"
CODE = 4
#: Texts of so many bytes or more are incompressible if their raw ratio is below the limit.
RAW_LIMITS = ((64 << 10, 1.6), (8 << 10, 1.5), (1 << 10, 1.25))


def limit(n_words: int, share: float = SHARE) -> float:
    """Least ratio raw/compressed at which n_words words may have the share of repeats."""
    raw = float(CODE * n_words)
    repeated = max(0.0, share * (n_words - RUN + 1))
    most = raw - CODE * repeated + MATCH_BYTES * math.ceil(repeated / RUN + 1) + FRAME_BYTES
    return raw / most if most < raw else 0.0


def compressor(n_words: int):
    """zstandard tuned to find repeats of two words and more anywhere in n_words words."""
    import zstandard as zstd

    log = min(27, max(10, (CODE * n_words - 1).bit_length()))
    params = zstd.ZstdCompressionParameters(
        window_log=log, chain_log=min(24, log + 1), hash_log=min(22, log), search_log=min(9, max(4, log - 5)), min_match=7, target_length=64,
        strategy=zstd.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return zstd.ZstdCompressor(compression_params=params)


def codes(tokens: list[str]) -> np.ndarray:
    """Codes of the words; words that share one only make a document a candidate in vain."""
    known: dict[str, int] = {}
    h = xxhash.xxh32_intdigest
    return np.fromiter((known[t] if t in known else known.setdefault(t, h(t)) for t in tokens), np.uint32, len(tokens))


def incompressible(raw_bytes: int, raw_ratio: float) -> bool:
    return next((raw_ratio < least for size, least in RAW_LIMITS if raw_bytes >= size), False)


def repeated_share(tokens: list[str]) -> float:
    """Exactly 1 - (different / all runs of five consecutive words); 0 for texts with fewer words.

    Runs are compared by ranks, not by hashes: words get ranks, pairs of words, pairs of pairs and
    those with a fifth word, each from the ranks of their parts, so a text of any length takes
    a few numbers a word.
    """
    n = len(tokens) - RUN + 1
    if n <= 0:
        return 0.0
    known: dict[str, int] = {}
    one = np.array([known.setdefault(t, len(known)) for t in tokens], np.int64)
    two = _ranks(one[:-1], one[1:])
    four = _ranks(two[:-2], two[2:])
    return 1 - len(np.unique(four[:n] * len(known) + one[RUN - 1 :])) / n


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def score(text: str | None, share: float = SHARE) -> tuple[int, float | None, float | None, float | None, str, float | None]:
    """(words, ratio, highest chunk ratio, raw ratio, band, exact share or NULL where the band rules it out).

    Bands: `short` (fewer than LEAST_WORDS words, NULL and empty texts too), `repetitive`
    (a candidate, measured exactly), `incompressible`, `plain`. A document of more than TABLE_WORDS
    words is always a candidate.
    """
    import zstandard as zstd

    tokens = words(text)
    n = len(tokens)
    if n < LEAST_WORDS:
        return n, None, None, None, "short", None
    raw = text.encode("utf-8", "surrogatepass")
    raw_ratio = len(raw) / len(zstd.ZstdCompressor(level=1).compress(raw))
    data = codes(tokens).tobytes()
    ratio = chunk = len(data) / len(compressor(n).compress(data))
    if n > CHUNK_WORDS:
        step = CODE * CHUNK_WORDS
        comp = compressor(CHUNK_WORDS)
        chunk = max(len(p) / len(comp.compress(p)) for i in range(0, len(data), step) if (p := data[i : i + step]))
    if ratio >= limit(n, share) or chunk >= 1.5 * limit(CHUNK_WORDS, share) or n > TABLE_WORDS:
        return n, ratio, chunk, raw_ratio, "repetitive", repeated_share(tokens)
    return n, ratio, chunk, raw_ratio, "incompressible" if incompressible(len(raw), raw_ratio) else "plain", None


def scores(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """Band and scores of every document; narrow, one pass, only doc_id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [score(t, share) for t in batch.column(1).to_pylist()]
            n, ratio, chunk, raw, band, exact = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(ratio, pa.float64()),
                    pa.array(chunk, pa.float64()),
                    pa.array(raw, pa.float64()),
                    pa.array(band, pa.string()),
                    pa.array(exact, pa.float64()),
                ],
                names=["doc_id", "n_words", "ratio", "chunk_ratio", "raw_ratio", "band", "share"],
            )

    return spread(documents.select(F.col("doc_id").cast("bigint"), "text")).mapInArrow(run, SCORES)


def repetitive(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """Documents of LEAST_WORDS or more words whose share of repeated runs is at least `share`."""
    # A share is a quotient of counts; the margin only undoes the rounding of 1 - q.
    return scores(documents, share).filter((F.col("band") == "repetitive") & (F.col("share") >= share - 1e-12)).select("doc_id").distinct()
