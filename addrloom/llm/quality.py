"""Quality rules: counts over words and lines, and compression bands.

The bands bound compressed / raw size under zstandard, for the whole document and for fixed chunks of two
sizes, the last of which ends with the document. Limits depend on the length, as short texts compress less: below the lower limit a text is
repetitive, above the upper one it is no prose (random strings, encoded data).
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from addrloom.llm.common import text_batches

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LEVEL = 3
#: Words of a text from which on its windows are counted in arrays.
MANY_WORDS = 20_000
#: (bytes from, lowest ratio, highest ratio) for whole documents.
#: The highest ratios lie just above those of all documents of sf0.1 of the length (the 0.999 quantile or the largest).
BANDS = ((0, 0.0, 1.60), (40, 0.22, 1.23), (80, 0.22, 1.10), (120, 0.22, 0.93), (160, 0.22, 0.91), (200, 0.22, 0.86), (260, 0.22, 0.75), (400, 0.22, 0.71), (550, 0.22, 0.685), (700, 0.22, 0.64), (1000, 0.22, 0.595), (1400, 0.22, 0.556), (2000, 0.22, 0.522), (2800, 0.22, 0.507), (4000, 0.20, 0.48), (5600, 0.20, 0.472), (8000, 0.20, 0.455), (16000, 0.16, 0.44))
#: (bytes, lowest ratio, highest ratio) of chunks, and the share of one size from which on chunks outside reject.
CHUNKS = ((1024, 0.12, 0.605), (4096, 0.12, 0.49))
CHUNK_SHARE = 0.1
#: Text of Chinese characters, kana or Hangul (three bytes each, leads E3 to ED, WIDE of all bytes at least) holds more in a byte: it
#: may reach this much above the highest ratios. Prose of 3,500 characters came up to 0.04 above from 1,000 bytes on, random ones 0.11 and more.
WIDE, WIDE_ROOM = 0.5, 0.09
_NOT_LEADS = bytes(b for b in range(256) if not 0xE3 <= b <= 0xED)
OUT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, chunks_outside bigint"


def repeat_words(words: list[bytes], n: int = 5) -> int:
    """Words inside windows of ``n`` words that occur twice or more in the text, the first one included."""
    if len(words) < n:
        return 0
    if len(words) > MANY_WORDS:
        return _repeat_words_of_many(words, n)
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + n - max(i, end)
            end = i + n
    return covered


def _repeat_words_of_many(words: list[bytes], n: int) -> int:
    """The same in arrays of numbers: equal windows get equal numbers, a word at a time."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    n_words = len(known)
    del known
    window = ids
    for k in range(1, n):  # numbers of windows of k words and of words are below 2**31 each
        _, window = np.unique(window[:-1] * n_words + ids[k:], return_inverse=True)
    twice = np.bincount(window)[window] > 1
    change = np.zeros(len(words) + 1, np.int64)
    change[: len(window)] += twice
    change[n : n + len(window)] -= twice
    return int((np.cumsum(change) > 0).sum())


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1 or len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def band_verdict(data: bytes, press: zstandard.ZstdCompressor) -> tuple[bool, float | None, int]:
    """Whether ``data`` is within the bands, its ratio (None: empty) and the number of chunks outside theirs."""
    if not data:
        return True, None, 0
    k = bisect_right([b[0] for b in BANDS], len(data)) - 1
    leads = len(data.translate(None, _NOT_LEADS))
    sums = np.zeros(1, np.int64)
    if leads:
        values = np.frombuffer(data, np.uint8)
        sums = np.concatenate(([0], np.cumsum((values >= 0xE3) & (values <= 0xED))))
    room = lambda lo, n: WIDE_ROOM if leads and 3 * (sums[lo + n] - sums[lo]) >= WIDE * n else 0.0
    ratio = len(press.compress(data)) / len(data)
    good, outside = BANDS[k][1] <= ratio <= BANDS[k][2] + room(0, len(data)), 0
    for size, low, high in CHUNKS:
        if len(data) < size:
            continue
        starts = [*range(0, len(data) - size, size), len(data) - size]
        found = sum(not low <= len(press.compress(data[i : i + size])) / size <= high + room(i, size) for i in starts)
        good &= found < max(1, CHUNK_SHARE * len(starts))
        outside += found
    return bool(good), ratio, outside


def measure(text: str | None, press: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, repeats = len(words), repeat_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    good, ratio, outside = band_verdict(data, press)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return n, chars, sum(text.count(c) for c in SYMBOLS), dup_lines(text), repeats, failed, good and not failed, ratio, outside


def quality(docs: DataFrame, extra: str | None = None) -> DataFrame:
    """The columns of OUT for each row of ``docs`` (doc_id, text); null text counts as empty."""
    names = [f.split()[0] for f in OUT.split(", ")]
    types = [{"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.split()[1]] for f in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            found = [measure(t, press) for lo in range(0, b.num_rows, 256) for t in b.column("text").slice(lo, 256).to_pylist()]
            cols = list(zip(*found)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types[1:]))], names=names)

    text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def op9_quality(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, kept, ratio and chunks_outside of every document.

    Null text counts as empty and fails the base rules; repeated rows and null ids keep their rows; an
    empty table gives no rows; other columns are ignored.
    """
    return quality(docs)
