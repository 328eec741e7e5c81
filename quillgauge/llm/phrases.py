"""Phrase collocations, counted in HAT-tries.

Phrases of 1 to 4 words are counted level by level.  Each task keeps one trie a
language over numbers it gives to words: the first word leads to a hash
container of the words behind it with their counts, and a container that grows
too large bursts into a node by the next word with a container for each.  Once
a task holds ``ENTRIES`` entries, its largest subtrees are spilled whole, as
runs in word order; the runs of all tasks meet in the partition of their
prefix, all words but the last, where their counts are added up.

A phrase cannot be frequent unless both phrases that it has without its last
and its first word are.  So a level counts only phrases whose two parts a bit
table of fixed size knows from the level before; entries in it that are not
frequent cost time, not exactness, as counts are complete and the threshold is
put to them afterwards.

Scores follow from the counts of frequent phrases alone, by joins: the lowest
of a phrase's cuts, without phrases that live almost only inside a longer one.

Edge cases: a null text has no words and a null language is ``und``; an empty
text, or one of marks alone, counts nothing; very long texts and words are
taken whole; equal scores are ordered by count and then by phrase; repeated
rows count each time; an empty table gives no rows; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import hot_join, settle

LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase goes if this share of it lies inside one longer phrase, in hundredths.
INSIDE = 80
SCALE = 2_000_000
#: Entries of a container before it bursts, of all tries of a task before the largest are spilled, and words numbered at a time.
BURST, ENTRIES, WORDS = 4096, 1_000_000, 600_000
#: Characters of text that are counted together, and rows of a batch that is handed on.
CHUNK_CHARS, BATCH = 2 << 20, 100_000
#: The bit table has two to this many bits, whatever the size of the corpus.
TABLE_BITS = 27
#: Bits of a word's number in a packed key.
WIDTH = 21
MASK = (1 << WIDTH) - 1

# Marks end a piece; letters A-Z become small, a tab is a blank.
MARKS = bytes([*b".,;:!?", *range(0x0A, 0x0E)])
FOLD = bytes.maketrans(bytes(range(65, 91)) + MARKS + b"\t", bytes(range(97, 123)) + b"." * len(MARKS) + b" ")


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Words of the texts in order, and a number for each that differs where their pieces do."""
    raw = np.frombuffer("\n".join(texts).encode("utf-8", "replace").translate(FOLD), np.uint8)
    mark = raw == ord(".")
    held = ~mark & (raw != ord(" "))
    starts = np.flatnonzero(held & ~np.concatenate([[False], held[:-1]]))
    letters = np.cumsum(held, dtype=np.int32)
    offsets = np.append(letters[starts] - 1, letters[-1] if len(letters) else 0).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[held])])
    return words, np.cumsum(mark, dtype=np.int32)[starts]


def mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def places(seed: int, words: list[np.ndarray], bits: int) -> np.ndarray:
    """Place in a table of two to so many bits of each phrase, from the hashes of its first, second, ... words."""
    h = np.full(len(words[0]), seed, np.uint64)
    for w in words:
        h = mix(h, w)
    return h >> np.uint64(64 - bits)


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


class Trie:
    """Counts of phrases of one length and language by the numbers of their words."""

    def __init__(self, depth: int, burst: int = BURST):
        self.depth, self.burst = depth, burst
        self.root: dict[int, dict | Node] = {}
        self.size: dict[int, int] = {}
        self.single = np.zeros(0, np.int64)  # counts by number, where phrases are words

    def add(self, first: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of different phrases, sorted by their first word; ``rest`` packs the words behind it."""
        if self.depth == 1:
            if first[-1] >= len(self.single):
                self.single = np.concatenate([self.single, np.zeros(first[-1] + 1, np.int64)])
            self.single[first] += counts
            return
        edges = np.flatnonzero(np.diff(first)) + 1
        starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(first)]
        rest, counts, root = rest.tolist(), counts.tolist(), self.root
        for w, a, b in zip(first[starts].tolist(), starts, ends, strict=True):
            if w not in root:
                root[w] = dict(zip(rest[a:b], counts[a:b], strict=True))
                self.size[w] = b - a
            else:
                self.size[w] += insert(root[w], rest[a:b], counts[a:b])
            if type(root[w]) is dict and len(root[w]) > self.burst and self.depth > 2:
                root[w] = Node(root[w], self.depth - 1, self.burst)

    def entries(self) -> int:
        return sum(self.size.values())

    def pop(self, chosen: list[int], most: int = BATCH) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """Take subtrees out: a column for each word of their phrases, and the counts; about ``most`` entries at a time."""
        flat, size = [], 0
        for w in chosen:
            size += self.size.pop(w)
            flat += walk([w], self.root.pop(w))
            if size >= most:
                yield unpacked(flat, self.depth)
                flat, size = [], 0
        if flat:
            yield unpacked(flat, self.depth)


def unpacked(containers: list[tuple[list[int], dict]], depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns and counts of containers with the words that lead to them."""
    columns: list[list[np.ndarray]] = [[] for _ in range(depth)]
    counts = []
    for known in {len(prefix) for prefix, _ in containers}:
        same = [(prefix, c) for prefix, c in containers if len(prefix) == known]
        sizes = [len(c) for _, c in same]
        rest = np.fromiter(chain.from_iterable(c for _, c in same), np.int64, sum(sizes))
        counts.append(np.fromiter(chain.from_iterable(c.values() for _, c in same), np.int64, sum(sizes)))
        lead = np.repeat(np.array([prefix for prefix, _ in same], np.int64), sizes, axis=0)
        for k in range(depth):
            columns[k].append(lead[:, k] if k < known else rest >> (WIDTH * (depth - 1 - k)) & MASK)
    return [np.concatenate(c) for c in columns], np.concatenate(counts)


class Node:
    """A burst container: by the next word, containers of the words behind that."""

    def __init__(self, container: dict, depth: int, burst: int):
        self.shift, self.depth, self.burst = WIDTH * (depth - 1), depth, burst
        self.children: dict[int, dict | Node] = {}
        insert(self, list(container), list(container.values()))

    def child(self, w: int) -> dict | Node:
        return self.children.setdefault(w, {})


def insert(into: dict | Node, rest: list[int], counts: list[int]) -> int:
    """Add counts below a container or a node; the number of new entries."""
    if type(into) is dict:
        before, get = len(into), into.get
        for k, c in zip(rest, counts, strict=True):
            into[k] = get(k, 0) + c
        return len(into) - before
    groups: dict[int, tuple[list[int], list[int]]] = {}
    low = (1 << into.shift) - 1
    for k, c in zip(rest, counts, strict=True):
        ks, cs = groups.setdefault(k >> into.shift, ([], []))
        ks.append(k & low)
        cs.append(c)
    new = 0
    for w, (ks, cs) in groups.items():
        child = into.child(w)
        new += insert(child, ks, cs)
        if type(child) is dict and len(child) > into.burst and into.depth > 2:
            into.children[w] = Node(child, into.depth - 1, into.burst)
    return new


def walk(prefix: list[int], node: dict | Node) -> Iterator[tuple[list[int], dict]]:
    """The containers below a node, each with the words that lead to it."""
    if type(node) is dict:
        yield prefix, node
    else:
        for w, child in node.children.items():
            yield from walk([*prefix, w], child)


class Counter:
    """The tries of one task."""

    def __init__(self, depth: int, table: np.ndarray | None, entries: int = ENTRIES):
        self.depth, self.table, self.limit = depth, table, entries
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.tries: dict[str, Trie] = {}
        self.hashes = np.zeros(0, np.uint64)

    def number(self, words: pa.Array) -> np.ndarray:
        """Numbers of the words, in the order in which different ones are met."""
        coded, numbers = words.dictionary_encode(), self.numbers
        met = coded.dictionary.to_pylist()
        new = [w for w in met if w not in numbers]
        numbers.update(zip(new, range(len(numbers), len(numbers) + len(new)), strict=True))
        return np.array(list(map(numbers.__getitem__, met)), np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def known(self, lang: str, ids: np.ndarray) -> np.ndarray:
        """Whether the phrase of ``depth - 1`` words at each place is in the table."""
        if len(self.numbers) > len(self.hashes):
            new = list(self.numbers)[len(self.hashes) :]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(word_hash, new), np.uint64, len(new))])
        n = self.depth - 1
        at = places(word_hash(lang.encode()), [self.hashes[ids[k : len(ids) - n + 1 + k]] for k in range(n)], len(self.table).bit_length() + 5)
        return (self.table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def count(self, lang: str, texts: list[str]) -> None:
        words, piece = words_of(texts)
        n = self.depth
        if len(words) < n:
            return
        ids = self.number(words)
        inside = piece[: len(ids) - n + 1] == piece[n - 1 :]
        if self.table is not None:
            known = self.known(lang, ids)
            inside &= known[:-1] & known[1:]
        at = np.flatnonzero(inside)
        if not len(at):
            return
        first, rest = ids[at], np.zeros(len(at), np.int64)
        for k in range(1, n):
            rest = rest << WIDTH | ids[at + k]
        if n <= 3:
            key = np.sort(first << (WIDTH * (n - 1)) | rest)
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            first, rest = key[starts] >> (WIDTH * (n - 1)), key[starts] & ((1 << (WIDTH * (n - 1))) - 1)
        else:
            order = np.lexsort((rest, first))
            first, rest = first[order], rest[order]
            starts = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (rest[1:] != rest[:-1])]))
            first, rest = first[starts], rest[starts]
        self.tries.setdefault(lang, Trie(n)).add(first, rest, np.diff(np.append(starts, len(at))))

    def full(self) -> bool:
        return len(self.numbers) > WORDS or sum(t.entries() for t in self.tries.values()) > self.limit

    def spill(self, everything: bool) -> Iterator[pa.RecordBatch]:
        """Runs of the largest subtrees, until half of the room is free, or of all."""
        everything = everything or len(self.numbers) > WORDS
        vocabulary = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        order = np.empty(len(vocabulary), np.int64)
        order[pc.sort_indices(vocabulary).to_numpy()] = np.arange(len(vocabulary))
        trees = sorted(((size, lang, w) for lang, t in self.tries.items() for w, size in t.size.items()), reverse=True)
        left = sum(size for size, _, _ in trees)
        goal = 0 if everything else self.limit // 2
        by_lang: dict[str, list[int]] = {}
        for size, lang, w in trees:
            if left <= goal and not everything:
                break
            left -= size
            by_lang.setdefault(lang, []).append(w)
        for lang, chosen in by_lang.items():
            for columns, counts in self.tries[lang].pop(sorted(chosen, key=order.__getitem__)):
                yield self.run(lang, columns, counts, vocabulary, order)
        for lang, trie in self.tries.items():
            met = np.flatnonzero(trie.single)
            for i in range(0, len(met), BATCH):
                part = met[i : i + BATCH]
                yield self.run(lang, [part], trie.single[part], vocabulary, order)
            trie.single = np.zeros(0, np.int64)
        if everything:
            self.forget()

    def run(self, lang: str, columns: list[np.ndarray], counts: np.ndarray, vocabulary: pa.Array, order: np.ndarray) -> pa.RecordBatch:
        """Entries as a run in word order."""
        sort = np.lexsort([order[c] for c in reversed(columns)])
        words = [vocabulary.take(pa.array(c[sort])) for c in columns]
        if len(words) == 1:
            prefix, last = words[0], pa.array([""] * len(counts))
        else:
            prefix, last = pc.binary_join_element_wise(*words[:-1], " ") if len(words) > 2 else words[0], words[-1]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), prefix, last, pa.array(counts[sort])], names=["lang", "prefix", "word", "n"])


def count_level(docs: DataFrame, depth: int, table=None, entries: int = ENTRIES) -> DataFrame:
    """lang, phrase, f of all phrases of so many words; with a bit table (broadcast), of those whose parts are in it.

    docs: lang, text without nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(depth, None if table is None else table.value, entries)
        for batch in batches:
            held: dict[str, list[str]] = {}
            sizes: dict[str, int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                if sizes[lang] >= CHUNK_CHARS:
                    counter.count(lang, held.pop(lang))
                    del sizes[lang]
                    if counter.full():
                        yield from counter.spill(False)
            for lang, texts in held.items():
                counter.count(lang, texts)
            if counter.full():
                yield from counter.spill(False)
        yield from counter.spill(True)

    runs = docs.select("lang", "text").mapInArrow(run, "lang string, prefix string, word string, n long")
    merged = runs.repartition("lang", "prefix").groupBy("lang", "prefix", "word").agg(F.sum("n").alias("f"))
    return merged.select("lang", (F.col("prefix") if depth == 1 else F.concat_ws(" ", "prefix", "word")).alias("phrase"), "f")


def bit_table(phrases: DataFrame, size: int = TABLE_BITS) -> np.ndarray:
    """Bits of the phrases (lang, phrase) by their places: 2 ** size, gathered as at most that many / 64 numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            rows: dict[tuple[str, int], list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = phrase.encode().split(b" ")
                rows.setdefault((lang, len(words)), []).append(words)
            for (lang, n), found in rows.items():
                hashes = [np.fromiter((word_hash(w[k]) for w in found), np.uint64, len(found)) for k in range(n)]
                out.append(places(word_hash(lang.encode()), hashes, size).astype(np.int64))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], names=["place"])

    bits = phrases.select("lang", "phrase").mapInArrow(run, "place long")
    slots = bits.groupBy((F.shiftright("place", 6)).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (size - 6), np.uint64)
    table[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().astype(np.uint64)
    return table


@dataclass
class Frequent:
    """lang, phrase, f of the phrases that occur often enough, and lang, n of all words."""

    phrases: list[DataFrame]
    totals: DataFrame


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, entries: int = ENTRIES, bits: int = TABLE_BITS) -> Frequent:
    """Phrases of 1 to ``longest`` words, a table a length, each counted over the whole corpus."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    spark = docs.sparkSession
    words = settle(count_level(rows, 1, entries=entries), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [words.where(F.col("f") >= least)]
    for depth in range(2, longest + 1):
        table = spark.sparkContext.broadcast(bit_table(levels[-1], bits))
        levels.append(settle(count_level(rows, depth, table, entries).where(F.col("f") >= least), f"phrases-{depth}"))
        table.destroy()
    return Frequent(levels, totals)


def joined(words, first, size):
    return F.array_join(F.slice(words, first, size), " ")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, entries: int = ENTRIES, bits: int = TABLE_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of each language; docs: lang, text."""
    found = frequent_phrases(docs, least, longest, entries, bits)
    key = F.concat_ws("\n", "lang", "phrase").alias("key")  # no phrase has a line feed
    counts, candidates = None, None
    for k, level in enumerate(found.phrases):
        counts = level if counts is None else counts.unionByName(level)
        if k:
            candidates = level if candidates is None else candidates.unionByName(level)
    counts = counts.select(key, "f")
    candidates = candidates.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    size = F.size("words")

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    of = lambda part: F.concat(F.col("lang"), F.lit("\n"), part)
    cuts = cuts.select("lang", "phrase", "a", "k", of(joined("words", F.lit(1), F.col("k"))).alias("left"), of(joined("words", F.col("k") + 1, size)).alias("right"))
    cuts = settle(cuts, "cuts")
    total = cuts.count()
    for side, name in (("left", "l"), ("right", "r")):
        uses = cuts.groupBy(F.col(side).alias("key")).agg(F.count("*").alias("n"))
        sized = counts.join(uses, "key").select(F.col("key").alias(side), F.col("f").alias(name), "n")
        cuts = hot_join(cuts, sized, side, total)
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumn("both", exact("l") + exact("r")).withColumn("scaled", exact("a") * SCALE)
    scored = cuts.withColumn("score", F.expr("scaled div both")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.where(size > 2).select("lang", "a", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = longer.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("at"))
    around = inner.groupBy("lang", joined("words", F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("around"))
    free = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (exact("around") * 100 < exact("a") * INSIDE))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))  # limited before it is dealt
    out = free.withColumn("rank", rank).where(F.col("rank") <= top).join(found.totals, "lang")
    number = lambda c, name: F.col(c).cast("long").alias(name)
    return out.select("lang", number("rank", "rank"), "phrase", number("a", "a"), number("cut.l", "l"), number("cut.r", "r"), number("n", "n"), number("cut.score", "score"))
