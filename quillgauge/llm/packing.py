"""Cost-balanced packing of tokenised documents into sequences.

The cost of a piece of n tokens is estimated as linear plus quadratic in n (the
attention inside one document).  Pieces are taken in descending order of cost
and go to the sequence of the lowest cost so far that still has room for them;
a piece that fits nowhere whole is cut.  Full sequences cut from long documents
are set aside first.

Documents are packed partition by partition, in pools of bounded size, so
nothing is shuffled.  A pool opens just as many sequences as its tokens fill;
what is left over at the end of a partition becomes sequences whose lengths are
powers of two, which need no padding.

Edge cases: a null or empty text is a document of the end token alone; equal
and repeated rows are packed separately; of pieces as long, the one whose
document came first goes first, and of sequences that cost the same the first
is taken; a very long text is tokenised whole, in memory in proportion to it,
and cut into full sequences; a null doc_id stays null; an empty table gives no
pieces; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

CAPACITY = 2048
#: Tokens that a pool holds before it is packed.
POOL_TOKENS = 1 << 20
#: Weights of the linear and the quadratic part of a piece's cost.
LINEAR, QUADRATIC = 1.0, 1 / 1024
#: Pieces of text whose ids a Python worker remembers.
REMEMBER = 300_000
#: Bytes of text that are tokenised together (more where a single text is longer).
CHUNK_BYTES = 2 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 blank, 1 letter, 2 digit, 3 punctuation, 4 apostrophe, 5 all others."""
    out = np.full(256, 5, np.uint8)
    out[0x21:0x7F] = 3
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[ord("0") : ord("9") + 1] = 2
    out[ord("a") : ord("z") + 1] = 1
    out[ord("'")] = 4
    return out


BYTE_CLASS = byte_classes()
#: The character that stands for each byte in the vocabulary: itself if it is printable, else the next from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHAR = dict(zip((b for b in range(256) if b not in _SHOWN), map(chr, range(256, 512)), strict=False))

PLAIN_LETTERS, PLAIN_MARKS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+"), re.compile(rb"[!-&(-/:-@\[-`{-~]+")



def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class WordTokens:
    """Ids of texts as the tokenizer gives them, by pieces that it never joins.

    The tokenizer lower-cases, drops blanks, takes runs of letters, single
    digits, runs of other characters and a few endings behind an apostrophe,
    and merges inside these alone.  So texts are cut at blanks, around digits,
    before punctuation and, but for an apostrophe, behind it, all at once on
    their bytes; each different piece is looked up, or encoded where it is met
    for the first time.  Around bytes of other scripts nothing is cut: the
    library sees such pieces as they are, as it does whole texts that hold one
    of its special tokens.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces: what is one run straight by the merges, all others by the library."""
        known, model = self.known, self.tok.model
        ids = []
        for p in pieces:
            if p.isalnum() or PLAIN_MARKS.fullmatch(p):
                ids.append([t.id for t in model.tokenize(p.decode("ascii"))])
            elif PLAIN_LETTERS.fullmatch(p):
                ids.append([t.id for t in model.tokenize(p.decode("latin-1").translate(BYTE_CHAR))])
            else:
                ids.append(self.whole(p.decode("utf-8")))
        n, m = len(known), len(known) + len(ids)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = self.used + int(sizes.sum())
        if m > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.zeros(m, np.int64)]) for x in (self.begin, self.size))
        if total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(total, np.uint32)])
        self.begin[n:m], self.size[n:m] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : total] = np.fromiter((i for x in ids for i in x), np.uint32, total - self.used)
        self.used = total
        known.update(zip(pieces, range(n, m), strict=True))

    def cut(self, raw: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """Lower-cased pieces of a run of bytes, and where each begins."""
        low = raw.copy()
        low[(raw >= 65) & (raw <= 90)] += 32
        kind = BYTE_CLASS[low]
        lead = np.flatnonzero(raw[:-1] == 0xC3)  # letters of two bytes, but for the signs of multiplication and division
        second = raw[lead + 1]
        lead, second = lead[(second | 0x20) != 0xB7], second[(second | 0x20) != 0xB7]
        low[lead + 1] = np.where(second < 0x9F, second + 0x20, second)
        kind[lead] = kind[lead + 1] = 1
        a, b = kind[:-1], kind[1:]
        border = np.ones(len(low), bool)
        border[1:] = (a == 0) | (a == 2) | (b == 2) | ((a == 1) & (b > 2)) | ((a == 3) & (b == 1))
        border[1:] &= (a < 5) & (b < 5) | (a == 0)
        held = kind > 0
        starts = np.flatnonzero(border & held)
        offsets = np.append(np.cumsum(held)[starts] - 1, np.count_nonzero(held)).astype(np.int32)
        return starts, pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[held])])

    def chunk_ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, one after the other, and where each text begins among them."""
        at = np.cumsum([0, *[len(t) + 1 for t in texts]])
        starts, pieces = self.cut(np.frombuffer(b"\n".join([*texts, b""]), np.uint8)) if at[-1] > len(texts) else (np.zeros(0, np.int64), pa.array([], pa.binary()))
        coded = pieces.dictionary_encode()
        met = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBER:
            self.forget()
        self.learn([p for p in met if p not in self.known])
        own = np.fromiter(map(self.known.__getitem__, met), np.int64, len(met))[coded.indices.to_numpy(zero_copy_only=False)]
        sizes = self.size[own]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[own] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.searchsorted(starts, at)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        out: list[bytes] = []
        special = [SPECIAL.search(t) is not None for t in texts]
        raws = [b"" if s else t.encode("utf-8", "replace") for t, s in zip(texts, special, strict=True)]
        i = 0
        while i < len(raws):
            j, size = i + 1, len(raws[i])
            while j < len(raws) and size + len(raws[j]) < CHUNK_BYTES:
                size += len(raws[j])
                j += 1
            ids, at = self.chunk_ids(raws[i:j])
            flat = ids.astype("<u4", copy=False).tobytes()
            out += [flat[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            i = j
        for k in np.flatnonzero(special).tolist():
            out[k] = np.array(self.whole(texts[k]), "<u4").tobytes()
        return out


_LOADED: dict[str, WordTokens] = {}


def load(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


def powers(n: int, most: int) -> list[int]:
    """n as a sum of powers of two that are at most ``most``, largest first."""
    out = [most] * (n // most)
    return out + [1 << b for b in range(most.bit_length() - 1, -1, -1) if (n % most) >> b & 1]


def pack(pieces: list[tuple[int, int, int]], rooms: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Assign pieces (document, start, length) to sequences of the given rooms.

    Returns (document, start, length, sequence, offset).  The rooms must hold
    all tokens together; each of them is then filled.
    """
    room = np.array(rooms, np.int64)
    spent = np.zeros(len(rooms))
    used = np.zeros(len(rooms), np.int64)
    out = []
    for doc, start, length in sorted(pieces, key=lambda p: (-p[2], p[0], p[1])):
        while length:
            fits = room >= length
            best = int(np.argmin(np.where(fits if fits.any() else room > 0, spent, np.inf)))
            n = min(length, int(room[best]))
            out.append((doc, start, n, best, int(used[best])))
            room[best] -= n
            used[best] += n
            spent[best] += cost(n)
            start, length = start + n, length - n
    return out


class Pool:
    """Documents of one partition on their way into sequences."""

    def __init__(self, part: int, capacity: int):
        self.capacity, self.next_id = capacity, part << 40
        self.tails: list[tuple[int, int, int]] = []  # index of the document, start, length
        self.docs: list[tuple[int, bytes]] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        n = len(ids) // 4
        full = n - n % self.capacity
        for start in range(0, full, self.capacity):
            self.rows.append((doc_id, start, self.capacity, zlib.crc32(ids[4 * start : 4 * (start + self.capacity)]), n, self.next_id, 0))
            self.next_id += 1
        if n > full:
            self.tails.append((len(self.docs), full, n - full))
            self.docs.append((doc_id, ids))
            self.tokens += n - full

    def flush(self, last: bool) -> None:
        """Pack the tails; but for the last time, what fills no sequence stays in the pool."""
        spare = self.tokens % self.capacity
        tails, docs = self.tails, self.docs
        self.tails, self.docs, self.tokens = [], [], 0
        if spare and not last:
            tails = sorted(tails, key=lambda p: (p[2], p[0]))
            while spare:
                k, start, n = tails.pop(0)
                keep = min(n, spare)
                if keep < n:
                    tails.append((k, start, n - keep))
                self.tails.append((len(self.docs), start + n - keep, keep))
                self.docs.append(docs[k])
                self.tokens += keep
                spare -= keep
        total = sum(n for _, _, n in tails)
        rooms = powers(total, self.capacity)
        for k, start, n, seq, offset in pack(tails, rooms):
            doc_id, ids = docs[k]
            self.rows.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, self.next_id + seq, offset))
        self.next_id += len(rooms)

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows, strict=True)) if self.rows else [[]] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pool = load(path), Pool(TaskContext.get().partitionId(), capacity)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), 2048):
                part = [t or "" for t in texts[i : i + 2048]]
                for doc_id, ids in zip(doc_ids[i : i + 2048], tok.ids(part), strict=True):
                    pool.add(doc_id, ids + end)
                    if pool.tokens >= POOL_TOKENS:
                        pool.flush(last=False)
                        yield pool.take()
        pool.flush(last=True)
        yield pool.take()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
