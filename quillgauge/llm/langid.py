"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (one to
three letters, words padded with a blank), counted over all training texts.  A
document's own most frequent n-grams are ranked the same way; the distance to
a profile is the sum of how far each n-gram is out of place, n-grams that the
profile lacks counting as far as can be.  The nearest profile names the
language.

Edge cases: texts that are null or have no letter give ``und`` with score 0;
with no training rows every text gives ``und``; ties go to the first language
in code-point order, and n-grams as frequent are ranked by their letters; very
long texts are counted whole; repeated rows and equal texts give equal results;
an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "und"
PROFILE_SIZE = 300
#: Distinct n-grams that a task holds before it hands its partial counts on.
FLUSH = 400_000


def letter_table() -> np.ndarray:
    """Lower-cased letter for each code point of the basic plane; a blank for all that is no letter."""
    out = np.full(0x10000, 32, np.uint64)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_LETTERS: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Code points of the text: letters in lower case, one blank for each run of others, blanks at both ends."""
    if not _LETTERS:
        _LETTERS.append(letter_table())
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    plane = codes < 0x10000
    out = _LETTERS[0][np.where(plane, codes, 32)]
    if not plane.all():
        for i in np.flatnonzero(~plane):
            if chr(codes[i]).isalpha():
                out[i] = codes[i]
    blank = out == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank after a letter
    out = out[keep]
    return np.concatenate((np.array([32], np.uint64), out[int(len(out) > 0 and out[0] == 32) :], np.array([32], np.uint64)))


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of a text (21 bits a letter) and how often each occurs."""
    c = letters(text)
    if len(c) < 3:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    one = c[c != 32]
    three = three[c[1:-1] != 32]
    two = two[two != ((32 << 21) | 32)]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def unpack(key: int) -> str:
    s = ""
    while key:
        s, key = chr(key & 0x1FFFFF) + s, key >> 21
    return s


def ranked(keys: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams, most frequent first, ties by n-gram."""
    if len(keys) > 4 * k:  # np.unique has sorted the keys, so a stable sort keeps ties in order
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")[:k]]


@dataclass(frozen=True)
class Profiles:
    """Sorted n-grams of all profiles; place[i, l] is the rank of n-gram i in language l."""

    langs: tuple[str, ...]
    keys: np.ndarray
    place: np.ndarray
    size: int

    @classmethod
    def of(cls, ranked_by_lang: dict[str, list[int]], size: int) -> Profiles:
        langs = tuple(sorted(ranked_by_lang))
        keys = np.unique(np.array([k for v in ranked_by_lang.values() for k in v], np.uint64))
        place = np.full((len(keys) + 1, len(langs)), -1, np.int64)
        for j, lang in enumerate(langs):
            own = np.array(ranked_by_lang[lang], np.uint64)
            place[np.searchsorted(keys, own), j] = np.arange(len(own))
        return cls(langs, keys, place, size)

    def nearest(self, text: str | None) -> tuple[str, float]:
        if not text or not len(self.keys):
            return UNKNOWN, 0.0
        top = ranked(*ngrams(text), self.size)
        if not len(top):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, top)
        at[at == len(self.keys)] = len(self.keys) - 1
        at = np.where(self.keys[at] == top, at, len(self.keys))  # the last row: in no profile
        place = self.place[at]
        far = np.where(place < 0, self.size, np.abs(place - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (self.size * len(top)))


def held_out(doc_id: Column) -> Column:
    """True for a quarter of the documents, which training leaves out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def count_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language in one partition, merged before they are handed on."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    sizes: dict[str, int] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held[lang]])
        uniq, inv = np.unique(keys, return_inverse=True)
        return uniq, np.bincount(inv, weights=np.concatenate([n for _, n in held[lang]])).astype(np.int64)

    def rows(lang: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(keys.astype(np.int64)), "n": pa.array(counts)})

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            keys, counts = ngrams(text)
            held.setdefault(lang, []).append((keys, counts))
            sizes[lang] = sizes.get(lang, 0) + len(keys)
            if sizes[lang] > FLUSH:
                keys, counts = merged(lang)
                if len(keys) > FLUSH // 2:
                    yield rows(lang, keys, counts)
                    held[lang], sizes[lang] = [], 0
                else:
                    held[lang], sizes[lang] = [(keys, counts)], len(keys)
    for lang in held:
        if held[lang]:
            yield rows(lang, *merged(lang))


def train(docs: DataFrame, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of all languages in ``lang``, counted over all rows with a text and a language.

    What reaches the driver is ``size`` n-grams a language.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = rows.mapInArrow(count_partition, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").select("lang", "gram").collect():
        out.setdefault(r.lang, []).append(r.gram)
    return Profiles.of(out, size)


def predictor(profiles: Profiles):
    """A column function: text -> struct(lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.nearest(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """doc_id, lang_pred, score."""
    return docs.select("doc_id", predictor(profiles)(F.col("text")).alias("p")).select("doc_id", "p.lang_pred", "p.score")
