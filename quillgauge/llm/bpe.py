"""Byte-pair encoding and decoding by segment trees over adjacent pair ranks.

A piece of text is a list of symbols; a segment tree over its adjacent pairs
holds (merge rank, position) and its root gives the leftmost pair of the lowest
rank.  Merging that pair changes at most three leaves, each updated along one
path to the root, until no pair can be merged.  The trees of many pieces of
like length are held as one matrix and advance together.

A text is cut at its special tokens and then into pieces by the vocabulary's
pattern; pieces met before are looked up.

Edge cases: null and empty texts have no tokens; very long texts are encoded
whole, and an unbroken word of very many letters takes as many steps as it has
merges, each logarithmic; of pairs of equal rank the leftmost merges first; ids
outside the vocabulary decode to nothing; repeated rows and equal texts get
equal results; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a Python worker remembers; beyond that it keeps those of the batch at hand only.
REMEMBER = 400_000
#: Marks that end many words; they form pieces of their own.
MARKS = frozenset(".,;:!?|%$#*&)")
NONE = np.int64(1) << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, as published with the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    others = (b for b in range(256) if b not in set(plain))
    return out | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairs:
    """A byte-level vocabulary with its merges."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.bytes_of = {i: as_bytes(s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(pattern)
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        width = max(self.bytes_of) + 1
        self.width = np.int64(width)
        pair = np.array([vocab[a] * width + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks, self.made = np.append(pair[order], -1), np.append(order, -1), made
        self.digits = {i: str(i) for i in self.bytes_of}
        self.byte_rank = self.rank(self.first[:, None], self.first[None, :])
        self.rare_blank = re.compile("[\0\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        #: ids joined by commas, and the bytes that these ids decode to, of the words met.
        self.ids_of: dict[str, str] = {}
        self.raw_of: dict[str, bytes] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; NONE where there is none or a side is missing (-1)."""
        key = a * self.width + b
        at = np.searchsorted(self.pairs[:-1], key)
        return np.where((a >= 0) & (b >= 0) & (self.pairs[at] == key), self.ranks[at], NONE >> 32)

    def merge_all(self, pieces: list[bytes]) -> np.ndarray:
        """A row of token ids for each piece, -1 where a symbol is gone; the pieces should be of like length."""
        n, longest = len(pieces), max(map(len, pieces))
        size = 1 << max(1, (longest - 1).bit_length())
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(n, size)
        there = np.arange(size) < sizes[:, None]
        ids = np.full((n, size + 1), -1, np.int64)  # one column more, for "no neighbour"
        ids[:, :size] = np.where(there, self.first[raw], -1)
        after = np.minimum(np.arange(size + 1) + 1, size) + np.zeros((n, 1), np.int64)
        before = np.arange(size + 1) - 1 + np.zeros((n, 1), np.int64)
        before[:, 0] = size
        tree = np.full((n, 2 * size), NONE)
        tree[:, size : 2 * size - 1] = (np.where(there[:, 1:], self.byte_rank[raw[:, :-1], raw[:, 1:]], NONE >> 32) << 32) | np.arange(size - 1)
        for k in range(size - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = np.flatnonzero(tree[:, 1] < NONE - (NONE >> 1))
        none = NONE >> 32
        while len(live):
            root = tree[live, 1]
            at, rank = root & 0xFFFFFFFF, root >> 32
            right = after[live, at]
            far = after[live, right]
            near = before[live, at]
            ids[live, at] = self.made[rank]
            ids[live, right] = -1
            after[live, at] = far
            has_far = far < size
            before[live[has_far], far[has_far]] = at[has_far]
            left = np.where(near < size, ids[live, near], -1)
            new_here = self.rank(ids[live, at], np.where(has_far, ids[live, far], -1))
            new_left = self.rank(left, ids[live, at])
            self.update(tree, live, size + at, (new_here << 32) | at)
            self.update(tree, live, size + right, np.full(len(live), none << 32))
            has_near = near < size
            self.update(tree, live[has_near], size + near[has_near], (new_left[has_near] << 32) | near[has_near])
            live = live[tree[live, 1] >> 32 < none]
        return ids

    @staticmethod
    def update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """Set one leaf of each row's tree and mend the path to its root."""
        tree[rows, leaf] = value
        while len(leaf) and leaf[0] > 1:  # all leaves are at the same depth
            leaf = leaf >> 1
            tree[rows, leaf] = np.minimum(tree[rows, 2 * leaf], tree[rows, 2 * leaf + 1])

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for ids in map(self.ids_of.__getitem__, words) if ids for i in ids.split(",")] for words in self.words_batch(texts)]

    def words_batch(self, texts: list[str]) -> list[list[str]]:
        """The words of each text, all of which are known afterwards, until the next call."""
        cut_up = [self.split(t) for t in texts]
        met = set().union(*cut_up)
        if len(self.ids_of) > REMEMBER:
            for name in ("ids_of", "raw_of"):
                setattr(self, name, {w: v for w in met if (v := getattr(self, name).get(w)) is not None})
        self.learn([w for w in met if w not in self.ids_of])
        return cut_up

    def learn(self, words: list[str]) -> None:
        """Encode new words: those of one piece, then those of a known piece and a mark, then the rest."""
        known, raws, single, marked, others = self.ids_of, self.raw_of, {}, [], {}
        for w in words:
            if w[1:].isalpha() and (w[0] == " " or w[0].isalpha()):
                single[w] = None
            elif w[-1] in MARKS and w[1:-1].isalpha() and (w[0] == " " or w[0].isalpha()):
                marked.append(w)
                if w[:-1] not in known:
                    single[w[:-1]] = None
                if w[-1] not in known:
                    single[w[-1]] = None
            elif w in self.special:
                known[w], raws[w] = self.digits[self.special[w]], w.encode()
            else:
                others[w] = self.pattern.findall(w)
                single.update(dict.fromkeys([p for p in others[w] if p not in known]))
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in single:
            raw = p.encode("utf-8", "replace")
            by_size.setdefault((len(raw) - 1).bit_length(), []).append((p, raw))
        for group in by_size.values():
            step = max(1, 400_000 // max(len(r) for _, r in group))
            for i in range(0, len(group), step):
                part = group[i : i + step]
                ids = self.merge_all([r for _, r in part])
                there = ids >= 0
                flat = ids[there].tolist()
                digits, parts = list(map(self.digits.__getitem__, flat)), list(map(self.bytes_of.__getitem__, flat))
                ends = np.cumsum(there.sum(axis=1)).tolist()
                at = 0
                for (p, _), end in zip(part, ends, strict=True):
                    known[p], raws[p] = ",".join(digits[at:end]), b"".join(parts[at:end])
                    at = end
        for w in marked:
            known[w], raws[w] = f"{known[w[:-1]]},{known[w[-1]]}", raws[w[:-1]] + raws[w[-1]]
        for w, pieces in others.items():
            if pieces != [w]:
                known[w], raws[w] = ",".join([known[p] for p in pieces]), b"".join([raws[p] for p in pieces])

    def split(self, text: str) -> list[str]:
        if self.cut is None or not any(map(text.__contains__, self.special)):
            return self.split_plain(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self.split_plain(part) if part else []
        return out

    def split_plain(self, text: str) -> list[str]:
        """Words with the blank before them.

        A piece of the pattern never crosses a single blank between two
        characters that are no white space, so the ids of such a word do not
        depend on its neighbours.  Texts where white space meets white space
        are cut by the pattern itself.
        """
        if not text:
            return []
        blanks = text.count(" ") + text.count("\n") + text.count("\t")
        if len(text.split()) != blanks + 1 or self.rare_blank.search(text):
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[tuple[str, str], BytePairs] = {}


def load(path: str, pattern: str) -> BytePairs:
    """The vocabulary, read once in each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePairs(path, pattern)
    return _LOADED[path, pattern]


def encoder(path: str, pattern: str):
    """A column function: text -> array of ids."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(load(path, pattern).encode_batch([t or "" for t in texts]), dtype=object)

    return encode


def decoder(path: str, pattern: str):
    """A column function: array of ids -> text."""

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        bp = load(path, pattern)
        return pd.Series([bp.decode([] if x is None else x) for x in ids], dtype=object)

    return decode


def digests(path: str, pattern: str):
    """A column function: text -> struct(n_tokens, ids_sha256, decoded_sha256), the ids not leaving the worker."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        bp, rows = load(path, pattern), []
        texts = [t or "" for t in texts]
        for i in range(0, len(texts), 1024):
            for words in bp.words_batch(texts[i : i + 1024]):
                joined = ",".join(map(bp.ids_of.__getitem__, words))
                text = b"".join(map(bp.raw_of.__getitem__, words)).decode("utf-8", "replace").encode()
                rows.append((joined.count(",") + 1 if joined else 0, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids of each whole text."""
    return docs.select("doc_id", encoder(path, pattern)(F.coalesce("text", F.lit(""))).alias("ids"))


def encode_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""
    return docs.select("doc_id", digests(path, pattern)(F.coalesce("text", F.lit(""))).alias("d")).select("doc_id", "d.*")
