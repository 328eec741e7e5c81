"""Files of token ids: independent Zstandard frames with a seek table at the end.

A file is a run of Zstandard frames, a skippable frame with the table of its
documents, and the seek table of the public seekable format: for every frame
its compressed and its decompressed size and the low half of the XXH64 of its
content, then the number of frames and a magic number.  A reader takes the two
tables from the end of a file and decompresses the frames of the documents that
it is asked for, each held against its checksum; any Zstandard tool decompresses
a whole file to the ids.

Documents are dealt to files by ranges of doc_id, so files in order of their
part hold all ids in order; what lies before a file is summed up over the
manifest, a row a file.

Edge cases: a null or empty text is a document of the end id alone; null
doc_ids come first; rows that share a doc_id are ordered by the hash of their
text and may lie in several files, and repeated rows follow one another; a very
long text is encoded whole and lies in several frames; an empty table writes no
file; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

# Magic numbers and the checksum flag of the seekable format.
SEEK_FRAME = 0x184D2A5E
DOCUMENT_FRAME = 0x184D2A50
SEEK_MAGIC = 0x8F92EAB1
CHECKSUMS = 0x80

#: Ids of a frame, and bytes of a file, after which the next one begins.
FRAME_IDS, FILE_BYTES = 1 << 16, 256 << 20
LEVEL = 3
#: Words whose ids a Python worker remembers, and characters of text that are encoded together.
REMEMBER, CHUNK_CHARS = 800_000, 8 << 20
MANIFEST = "part int, number int, path string, first_id long, last_id long, documents long, ids long, bytes long"

#: Marks that are cut off the ends of words.
MARKS = b"!#$%&()*+,-./:;<=>?@[]^_`{|}~"
ONE_WORD = re.compile(r" ?\S+")
DOUBLE_BLANKS = ("  ", "\n\n", " \n", "\n ")
SINGLE_BLANK = re.compile(r"(?<=\S)(?= \S)")
RARE_BLANK = re.compile("[\0\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class ByteTokens:
    """Ids of texts as the tokenizer gives them, by words that it never joins.

    No piece of a byte-level vocabulary crosses a single blank between two
    characters that are no white space, nor a single line feed there, and none
    goes on from a letter to a mark; so texts are cut before such blanks and
    around such line feeds, marks are cut off the ends of words, and the library
    sees each different word once, many of them as the lines of one text.
    Texts that hold one of its special tokens go to the library whole.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        [self.line_feed] = self.whole("\n").tolist()
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, f"<u{self.width}")
        self.begin, self.size, self.uses = (np.zeros(0, np.int64) for _ in range(3))

    def forget(self, keep: int) -> None:
        """Keep the words used most, ``keep`` of them at most and none that was used once."""
        least = max(2, int(np.partition(self.uses, -keep)[-keep]) + 1)
        old = np.flatnonzero(self.uses >= least)
        words = list(self.known)
        self.known = dict(zip(map(words.__getitem__, old.tolist()), range(len(old)), strict=True))
        self.flat, self.size = self.ids_of(old), self.size[old]
        self.begin, self.uses = np.cumsum(self.size) - self.size, self.uses[old] // 2

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")

    def put(self, numbers: list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Note the ids of words, given one after the other."""
        self.begin[numbers] = len(self.flat) + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.flat = np.concatenate([self.flat, ids.astype(self.flat.dtype)])

    def look_up(self, words: list[bytes]) -> tuple[list[int], list[bytes]]:
        """Numbers of words, and those of them that are new."""
        new = list(dict.fromkeys([w for w in words if w not in self.known]))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        return list(map(self.known.__getitem__, words)), new

    def learn(self, new: list[bytes]) -> None:
        bodies = [w.rstrip(MARKS) for w in new]
        marked = [(w, b) for w, b in zip(new, bodies, strict=True) if b and len(b) < len(w) and b[-1:].isalpha()]
        apart = {w for w, _ in marked}
        body, new_bodies = self.look_up([b for _, b in marked])
        tail, new_tails = self.look_up([w[len(b) :] for w, b in marked])
        plain = [w for w in new if w not in apart] + new_bodies + new_tails
        texts = [w.decode() for w in plain]
        more = np.zeros(len(self.known) - len(self.begin), np.int64)
        self.begin, self.size, self.uses = (np.concatenate([x, more]) for x in (self.begin, self.size, self.uses))
        one_word = [ONE_WORD.fullmatch(t) is not None for t in texts]
        lines = [x for x, one in zip(zip(plain, texts, strict=True), one_word, strict=True) if one]
        for i in range(0, len(lines), 50_000):
            part = lines[i : i + 50_000]
            ids = self.whole("\n".join([t for _, t in part]))
            ends = np.append(np.flatnonzero(ids == self.line_feed), len(ids))
            self.put([self.known[w] for w, _ in part], ids[ids != self.line_feed], np.diff(ends, prepend=-1) - 1)
        for w, text, one in zip(plain, texts, one_word, strict=True):
            if not one:
                ids = self.whole(text)
                self.put([self.known[w]], ids, np.array([len(ids)]))
        if marked:
            both = np.stack([body, tail], 1)
            self.put([self.known[w] for w, _ in marked], self.ids_of(both.ravel()), self.size[both].sum(axis=1))

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of known words, one after the other."""
        sizes = self.size[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.begin[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Numbers of words, all of which are known afterwards."""
        coded = words.dictionary_encode()
        found, new = self.look_up(coded.dictionary.to_pylist())
        self.learn(new)
        met = np.array(found, np.int64)
        out = met[coded.indices.to_numpy(zero_copy_only=False)] if len(met) else met
        np.add.at(self.uses, out, 1)
        return out

    def even(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of texts in which each blank and line feed stands alone."""
        raw = np.frombuffer(b"".join(texts), np.uint8)
        feed = raw == 10
        border = (raw == 32) | feed
        border[1:] |= feed[:-1]
        begins = np.cumsum([0, *map(len, texts)])
        border[begins[:-1][begins[:-1] < len(raw)]] = True
        starts = np.flatnonzero(border)
        numbers = self.numbers(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw)]))
        at = np.concatenate([[0], np.cumsum(self.size[numbers])])[np.searchsorted(starts, begins)] * self.width
        flat = self.ids_of(numbers).tobytes()
        return (flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))

    def uneven(self, text: str) -> bytes:
        return self.ids_of(self.numbers(pa.array([w.encode() for w in SINGLE_BLANK.split(text)], pa.binary()))).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian numbers of ``width`` bytes."""
        if len(self.known) > REMEMBER:
            self.forget(REMEMBER // 2)
        whole = [self.special is not None and self.special.search(t) is not None for t in texts]
        odd = [w or any(map(t.__contains__, DOUBLE_BLANKS)) or RARE_BLANK.search(t) is not None for t, w in zip(texts, whole, strict=True)]
        even = self.even([b"" if o else t.encode("utf-8", "replace") for t, o in zip(texts, odd, strict=True)])
        return [self.whole(t).tobytes() if w else self.uneven(t) if o else e for t, w, o, e in zip(texts, whole, odd, even, strict=True)]

    def ids_in_chunks(self, texts: Iterable[str]) -> Iterator[bytes]:
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= CHUNK_CHARS:
                yield from self.ids(held)
                held, size = [], 0
        yield from self.ids(held) if held else ()


_LOADED: dict[str, ByteTokens] = {}


def load(path: str) -> ByteTokens:
    if path not in _LOADED:
        _LOADED[path] = ByteTokens(path)
    return _LOADED[path]


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FileWriter:
    """One file on its way to a stream."""

    def __init__(self, stream, width: int, frame_ids: int = FRAME_IDS):
        self.stream, self.width, self.frame = stream, width, frame_ids * width
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.buffer = bytearray()
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.bytes = 0

    def put(self, block: bytes, size: int, checksum: int) -> None:
        self.stream.write(block)
        self.entries.append((len(block), size, checksum))
        self.bytes += len(block)

    def close_frame(self, content: bytes) -> None:
        self.put(self.packer.compress(content), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append a document; a frame ends behind the document that fills it, or inside one that fills it alone."""
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // self.width)
        self.buffer += ids
        while len(self.buffer) >= 2 * self.frame:
            self.close_frame(bytes(self.buffer[: self.frame]))
            del self.buffer[: self.frame]
        if len(self.buffer) >= self.frame:
            self.close_frame(bytes(self.buffer))
            self.buffer.clear()

    def finish(self) -> None:
        if self.buffer:
            self.close_frame(bytes(self.buffer))
        there = np.array([d is not None for d in self.doc_ids], np.uint8)
        numbers = np.array([d or 0 for d in self.doc_ids], "<i8")
        table = struct.pack("<QB", len(there), self.width) + self.packer.compress(there.tobytes() + numbers.tobytes() + np.array(self.sizes, "<u8").tobytes())
        self.put(skippable(DOCUMENT_FRAME, table), 0, 0)
        rows = b"".join(struct.pack("<III", *e) for e in self.entries)
        tail = skippable(SEEK_FRAME, rows + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEK_MAGIC))
        self.stream.write(tail)
        self.bytes += len(tail)


class FileReader:
    """The tables of a file, and its documents on demand; ``stream`` can seek."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.seek(0, 2)
        frames, flags, magic = struct.unpack("<IBI", self.at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        head = end - 9 - 12 * frames - 8
        if struct.unpack("<II", self.at(head, 8)) != (SEEK_FRAME, 12 * frames + 9):
            raise ValueError("damaged seek table")
        table = np.frombuffer(self.at(head + 8, 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.checksums = table[:-1, 0], table[:-1, 2]
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0])])
        if self.offsets[-1] != head:
            raise ValueError("damaged seek table")
        self.ends = np.cumsum(table[:-1, 1])  # of the frames' contents
        docs = self.at(int(self.offsets[-2]) + 8, int(table[-1, 0]) - 8)
        n, self.width = struct.unpack("<QB", docs[:9])
        raw = zstandard.decompress(docs[9:]) if n else b""
        self.there = np.frombuffer(raw, np.uint8, n).astype(bool)
        self.doc_ids = np.frombuffer(raw, "<i8", n, n)
        self.sizes = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.decompressed = 0

    def at(self, place: int, size: int) -> bytes:
        self.stream.seek(place)
        out = self.stream.read(size)
        if len(out) != size:
            raise ValueError("file cut short")
        return out

    def frame(self, k: int) -> bytes:
        content = zstandard.decompress(self.at(int(self.offsets[k]), int(self.packed[k])))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checksums[k]:
            raise ValueError(f"frame {k} differs from its checksum")
        self.decompressed += 1
        return content

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place of the first id in the file, ids; of all documents or those of the wanted ids."""
        chosen = range(len(self.sizes)) if wanted is None else np.flatnonzero(self.there & np.isin(self.doc_ids, list(wanted))).tolist()
        held: dict[int, bytes] = {}
        for d in chosen:
            a, b = int(self.starts[d]) * self.width, int(self.starts[d] + self.sizes[d]) * self.width
            first, last = (int(np.searchsorted(self.ends, x, "right")) for x in (a, b - 1))
            held = {k: held[k] if k in held else self.frame(k) for k in range(first, last + 1)}
            begin = int(self.ends[first - 1]) if first else 0
            content = held[first] if first == last else b"".join(held.values())
            yield int(self.doc_ids[d]) if self.there[d] else None, int(self.starts[d]), np.frombuffer(content[a - begin : b - begin], f"<u{self.width}")


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents in ascending order of doc_id; the manifest, a row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task, tok = TaskContext.get(), load(tokenizer)
        end = np.array([end_id], f"<u{tok.width}").tobytes()
        temp = f"{base}/.attempt-{task.taskAttemptId()}"
        out, number = None, 0

        def close() -> pa.RecordBatch:
            nonlocal out, number
            out.finish()
            out.stream.close()
            path = f"{base}/part-{task.partitionId():05d}-{number:05d}-attempt-{task.taskAttemptId()}.ids.zst"
            system.move(temp, path)  # nobody else has this name
            known = [d for d in out.doc_ids if d is not None] or [None]
            row = [task.partitionId(), number, path, known[0], known[-1], len(out.sizes), sum(out.sizes), out.bytes]
            out, number = None, number + 1
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            texts = (t or "" for t in batch.column(1).to_pylist())
            for doc_id, ids in zip(batch.column(0).to_pylist(), tok.ids_in_chunks(texts), strict=True):
                out = out or FileWriter(system.open_output_stream(temp, compression=None), tok.width)
                out.add(doc_id, ids + end)
                if out.bytes >= file_bytes:
                    yield close()
        if out is not None:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    path = f"{folder}-manifest"
    ranged.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(MANIFEST).parquet(path)


def read_token_files(manifest: DataFrame, folder: str, wanted: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the documents in the files, and their ids if asked for.

    ``start`` counts all ids before a document.  With ``wanted`` ids, files that
    cannot hold one are left out, and of the others only the frames with these
    documents are decompressed.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before)  # a row a file
    if wanted is not None:
        wanted = sorted(set(wanted))
        files = files.where(F.exists(F.array(*[F.lit(w).cast("long") for w in wanted]), lambda w: w.between(F.col("first_id"), F.col("last_id"))))
    names, kinds = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids, [*[pa.int64()] * 4, pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(path) as f:
                    rows, size = [], 0
                    for doc_id, at, ids in FileReader(f).documents(wanted):
                        rows.append((doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *([ids] if with_ids else [])))
                        size += 8 + len(ids) * with_ids
                        if size > 1 << 20:
                            yield give(rows)
                            rows, size = [], 0
                    if rows:
                        yield give(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return files.select("path", "before").repartition(max(1, manifest.count()), "path").mapInArrow(run, schema)  # rows are few bytes, files are not
