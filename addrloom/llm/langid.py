"""Language identification, words first: known words by per-language log frequency, unseen ones by ever shorter n-grams.

A word of the model adds its log frequency in each language. An unseen word is cut into its n-grams of the
longest length of which any is known, from MAX_N down to 1, and adds their mean; a word of which no
character is known adds nothing.

Words are taken by Spark, in learning and in predicting by the same expression: a letter, then letters, combining
marks and joiners, in lower case. A worker scores the distinct words of a batch at once, in numpy: keys of words and
n-grams are 64-bit hashes in sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from addrloom.llm.common import freed, hidden, text_batches

WORDS = r"\p{L}[\p{L}\p{M}\x{200C}\x{200D}]*"
MAX_N = 5
#: Words that a posterior is based on at most. The model takes words as independent, which they aren't: summed up over a
#: long text, a hair's breadth between two languages would become certainty. With the mean of all words, weighed as so many,
#: the score says how clear a text is, whatever its length; keep_known rejects by it.
EVIDENCE = 12
#: n-grams hashed, words summed up at a time.
STEP = 1 << 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def word_keys(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def grams(words: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys of all n-grams and the words that they are from, some at a time; with n > 1 words have a blank on both sides."""
    codes = np.frombuffer(f" {'  '.join(words.to_pylist())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(size + 2) - (size + 2)
    counts = size if n == 1 else np.maximum(size + 3 - n, 0)
    ends = np.cumsum(counts)
    first = starts + (n == 1) - (ends - counts)  # place of a word's first n-gram, less the number of n-grams before
    for lo in range(0, int(ends[-1]) if len(ends) else 0, STEP):
        k = np.arange(lo, min(lo + STEP, int(ends[-1])))
        of = np.searchsorted(ends, k, side="right")
        at = first[of] + k
        h = np.full(len(k), n, np.uint64)
        for j in range(n):
            h = (h ^ codes[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        yield h, of


class Table:
    """Rows of log frequencies by language, by key; a row of nothing but the least for keys that one language lacks."""

    def __init__(self, keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int):
        self.keys, rows = np.unique(keys, return_inverse=True)
        table = np.zeros((len(self.keys), max(1, n_langs)))
        np.add.at(table, (rows, langs), counts)
        self.logs = np.log((table + 0.1) / (table.sum(axis=0) + 1.0)).astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are known, and the rows of these."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return known, at[known]


class Model:
    """Per-language log frequencies of words and of character n-grams, from (language, word, count)."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        words = pa.array([w for _, w, _ in counts], pa.string())
        langs, n = np.array([at[lang] for lang, _, _ in counts], np.int64), np.array([c for *_, c in counts], np.int64)
        self.words = Table(word_keys(words), langs, n, len(self.langs))
        self.grams = []
        for k in range(1, MAX_N + 1):
            keys, of = (np.concatenate(x) for x in zip(*([(np.zeros(0, np.uint64), np.zeros(0, np.int64))] + list(grams(words, k)))))
            self.grams.append(Table(keys, langs[of], n[of], len(self.langs)))

    def scores(self, words: pa.Array) -> np.ndarray:
        """A row of log frequencies for each of the distinct ``words``."""
        out = np.zeros((len(words), max(1, len(self.langs))))
        known, rows = self.words.find(word_keys(words))
        out[known] = self.words.logs[rows]
        left = np.flatnonzero(~known)
        for table, n in zip(self.grams[::-1], range(MAX_N, 0, -1)):
            if not len(left):
                break
            total, count = np.zeros((len(left), out.shape[1])), np.zeros(len(left))
            for keys, of in grams(words.take(pa.array(left)), n):
                known, rows = table.find(keys)
                of = of[known]
                count += np.bincount(of, minlength=len(left))
                for lang in range(out.shape[1]):
                    total[:, lang] += np.bincount(of, table.logs[rows, lang], len(left))
            has = count > 0
            out[left[has]] = total[has] / count[has, None]
            left = left[~has]
        return out

    def predict(self, words: pa.ListArray, evidence: int = EVIDENCE) -> tuple[list[str], np.ndarray]:
        """The best language of each list of words and its posterior; ``und`` and 0 without words, or if no language was learned."""
        size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        if not self.langs:
            return ["und"] * len(words), np.zeros(len(words))
        distinct = words.flatten().dictionary_encode()
        scores, index = self.scores(distinct.dictionary), distinct.indices.to_numpy()
        total, ends = np.zeros((len(words), len(self.langs))), np.cumsum(size)
        for lo in range(0, len(index), STEP):
            part = index[lo : lo + STEP]
            of = np.searchsorted(ends, np.arange(lo, lo + len(part)), side="right")
            for lang in range(len(self.langs)):
                total[:, lang] += np.bincount(of, scores[part, lang], len(words))
        logs = total / np.maximum(size, 1)[:, None] * np.minimum(size, evidence)[:, None]
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        best = p.argmax(axis=1)
        score = np.where(size > 0, p[np.arange(len(p)), best] / p.sum(axis=1), 0.0)
        return [self.langs[k] if n else "und" for k, n in zip(best.tolist(), size.tolist())], score


def in_fold(doc_id) -> object:
    """The held-out fold: crc32 of doc_id as text, mod 3, is 1 (null counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, max_docs: int = 2000) -> Model:
    """Learns from text and non-null lang of documents outside the held-out fold: all words and n-grams of a bounded sample.

    The sample holds about ``max_docs`` documents, drawn by a hash of doc_id and text; the driver gets their
    (language, word) counts. On the tables at hand, more documents make it no more accurate.
    """
    labelled = docs.where(F.col("lang").isNotNull() & ~in_fold("doc_id"))
    share = min(1.0, max_docs / max(labelled.select("lang").count(), 1))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 31)) <= int(share * (1 << 31)))
    words = drawn.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n")).toArrow().sort_by([("lang", "ascending"), ("word", "ascending")])
    return Model(list(zip(*(counts.column(c).to_pylist() for c in ("lang", "word", "n")))))


def predict(docs: DataFrame, model: Model, text: str = "text", evidence: int = EVIDENCE) -> DataFrame:
    """``docs`` with lang_pred and score, from the column ``text``."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score = shared.value.predict(b.column(b.num_columns - 1), evidence)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(score)], names=[*b.schema.names[:-1], "lang_pred", "score"])

    return docs.select("*", words_of(F.col(text)).alias("_words_of_text")).mapInArrow(freed(run), schema)


def op8_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    ``und`` and 0 for null text, text without letters, or if nothing could be learned; equal texts get
    equal predictions; repeated rows and null ids keep their rows; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", in_fold("doc_id").alias("held_out"))
    return predict(rows, fit(docs)).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = 0.35, langs: tuple[str, ...] | None = None, evidence: int = EVIDENCE) -> DataFrame:
    """``docs`` without those of no language, of one outside ``langs`` (None: any learned one), or of a posterior below ``min_score``."""
    own, names = hidden(docs)
    found = predict(own, fit(docs), own.columns[docs.columns.index("text")], evidence).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return (found.where(F.col("lang_pred").isin(*langs)) if langs else found).select(*names)
