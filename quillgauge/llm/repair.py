"""Repair of damaged conversations: the cheapest edits that make roles alternate, by a grammar-compressed dynamic program.

Each row of a conversation is one of twelve symbols, its role with what is
wrong with it.  Re-Pair replaces the most frequent pairs of adjacent symbols,
counted over the different strings of symbols of all conversations, by rules of
a grammar that all of them share.  A symbol's transfer matrix holds, for each
pair of states of the wanted pattern ``(s?(ua)+)?``, the least cost of the edits
of its rows and a rope of these edits; a rule's matrix is the min-plus product
of its two parts, made once, bottom-up, and a conversation's is the product
over its compressed string.  Insertions stand directly before the edit of a row
or at the end of the conversation, so no audit of the same rows begins another,
and the least audit of a product is made of least audits.

Rows are numbered by a sorted pass over ranges, and strings are cut every
``SEGMENT`` rows, so a conversation of any length is spread over many tasks; its
blocks are multiplied in a tree.  Only its repaired rows are handed out in
order, streamed through one task without being held.

Edge cases: a null role or text is one space; null turns come first, rows of
the same turn are ordered by role and text, and a null conv_id is a
conversation like others; a role is known by its first letter and one that is
none of s, u, a cannot be kept; a conversation without rows costs nothing and
has an empty audit; repeated rows are duplicates; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.session import number_rows
from .shared import settle

#: Rows of a string of symbols, and blocks that are multiplied in one group.
SEGMENT, FAN = 1024, 64
#: Rounds of Re-Pair, and pairs without a symbol in common that a round replaces at most.
ROUNDS, PAIRS = 10, 16
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = "suao"
BLANKS = r"[\x20\x09-\x0D]"
#: Where an edit that emits a role leads to: states are 0 nothing, 1 system, 2 user, 3 assistant emitted last.
EMITS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
STATES = range(4)
NAMES = {2: "user", 3: "assistant"}


class Rope:
    """Edits as a tree of strings, flattened when they are looked at."""

    __slots__ = ("left", "right")

    def __init__(self, left: Rope | str, right: Rope | None = None):
        self.left, self.right = left, right

    def text(self) -> str:
        if self.right is not None:
            out, todo = [], [self]
            while todo:
                r = todo.pop()
                if r.right is None:
                    out.append(r.left)
                else:
                    todo += [r.right, r.left]
            self.left, self.right = "".join(out), None
        return self.left


class Block:
    """Rows one after the other: transfer matrix {(from, to): (cost, rope)}, first and last role, places where roles do not alternate."""

    __slots__ = ("cells", "first", "last", "illegal")

    def __init__(self, cells: dict[tuple[int, int], tuple[int, Rope]], first: str, last: str, illegal: int):
        self.cells, self.first, self.last, self.illegal = cells, first, last, illegal

    def __matmul__(self, other: Block) -> Block:
        illegal = self.illegal + other.illegal + (self.last + other.first not in ("su", "ua", "au"))
        return Block(product(self.cells, other.cells), self.first, other.last, illegal)


def better(a: tuple[int, Rope], b: tuple[int, Rope] | None) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and a[1].text() < b[1].text())


def product(left: dict, right: dict) -> dict:
    out: dict[tuple[int, int], tuple[int, Rope]] = {}
    for (i, k), (c, rope) in left.items():
        for j in STATES:
            if (k, j) in right:
                d, more = right[k, j]
                cell = (c + d, Rope(rope, more))
                if better(cell, out.get((i, j))):
                    out[i, j] = cell
    return out


def insertions() -> dict:
    """Up to two insertions between two rows."""
    one = {(i, j): (INSERT, Rope("I")) for role in "ua" for i, j in EMITS[role].items()}
    none = {(i, i): (0, Rope("")) for i in STATES}
    out = dict(none)
    for cells in (one, product(one, one)):
        out |= {k: v for k, v in cells.items() if better(v, out.get(k))}
    return out


def terminal(symbol: str) -> Block:
    """The block of one row: insertions before it, then its edit."""
    must_go = symbol in "1234"
    role = ROLES["1234".index(symbol)] if must_go else symbol.lower()
    cells = {(i, i): (DELETE, Rope("D")) for i in STATES}
    if not must_go:
        extra = TRUNCATED if symbol.isupper() else 0
        for emitted in "ua":
            cells |= {(i, j): (REROLE + extra, Rope("R")) for i, j in EMITS[emitted].items()}
        cells |= {(i, j): (extra, Rope("K")) for i, j in EMITS.get(role, {}).items()}
    return Block(product(insertions(), cells), role, role, 0)


def best_audit(block: Block | None) -> tuple[int, str]:
    """Cost and audit of the cheapest way from nothing to a finished pattern."""
    start = {(0, 0): (0, Rope(""))} if block is None else {k: v for k, v in block.cells.items() if k[0] == 0}
    ends = product(start, insertions())
    cost, rope = min((ends[0, j] for j in (0, 3) if (0, j) in ends), key=lambda cell: (cell[0], cell[1].text()))
    return cost, rope.text()


class Grammar:
    """Rules (symbol, pair) in the order they were made, and the block of each symbol."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.blocks = {s: terminal(s) for s in ROLES + ROLES.upper() + "1234"}
        for symbol, pair in rules:  # a rule's parts are made before it
            self.blocks[symbol] = self.blocks[pair[0]] @ self.blocks[pair[1]]
        self.known: dict[str, Block] = {}

    def compress(self, symbols: str) -> str:
        for symbol, pair in self.rules:
            symbols = symbols.replace(pair, symbol)
        return symbols

    def block(self, symbols: str) -> Block:
        if symbols not in self.known:
            first, *rest = self.compress(symbols)
            out = self.blocks[first]
            for s in rest:
                out = out @ self.blocks[s]
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[symbols] = out
        return self.known[symbols]


def learn_rules(strings: DataFrame, rounds: int = ROUNDS, pairs: int = PAIRS) -> list[tuple[str, str]]:
    """Re-Pair over a column ``symbols`` of different strings.

    A round replaces the most frequent pairs that have no symbol in common, so
    none of them changes how often another one occurs; at most ``rounds`` times
    ``pairs`` rules reach the driver.
    """
    rules: list[tuple[str, str]] = []
    s = F.col("symbols")
    for _ in range(rounds):
        at = F.sequence(F.lit(1), F.length("s") - 1)
        adjacent = strings.select(s.alias("s")).where(F.length("s") > 1).select(F.explode(F.transform(at, lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("pair"))
        top = adjacent.groupBy("pair").count().where("count > 1").orderBy(F.desc("count"), "pair").limit(16 * pairs).collect()
        used: set[str] = set()
        for r in top:
            if not used & set(r.pair) and len(used) < 2 * pairs:
                used |= set(r.pair)
                rules.append((chr(0x4E00 + len(rules)), r.pair))
                s = F.replace(s, F.lit(r.pair), F.lit(rules[-1][0]))
        if not used:
            break
    return rules


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, number (in the order of conversations and turns), fault, symbol of each row, settled."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", "turn", one_space("role"), one_space("text")).withColumn("stored", F.monotonically_increasing_id())
    rows = number_rows(rows, F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "stored").drop("stored")
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("number").alias("number")).select("number", F.lit(True).alias("new"))
    rows = rows.join(first, "number", "left")
    ended = F.col("text").rlike(rf"[.!?]{BLANKS}*\z")
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("new").isNull(), "duplicate").when(~ended, "truncated")
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), F.translate(role, ROLES, "1234")).when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    return settle(rows.withColumn("fault", fault).withColumn("symbol", symbol).drop("new"), "faults")


BLOCK = "first string, last string, illegal long, cells array<struct<i: int, j: int, cost: long, edits: string>>"


def as_row(b: Block) -> dict:
    return {"first": b.first, "last": b.last, "illegal": b.illegal, "cells": [{"i": i, "j": j, "cost": c, "edits": rope.text()} for (i, j), (c, rope) in b.cells.items()]}


def from_row(r: dict) -> Block:
    return Block({(c["i"], c["j"]): (c["cost"], Rope(c["edits"])) for c in r["cells"]}, r["first"], r["last"], r["illegal"])


def added(rows: DataFrame, column: str, kind: str, f: Callable[[object], dict]) -> DataFrame:
    """rows with the fields of ``f(column)`` in place of the column."""
    made_fields = rows.sparkSession.createDataFrame([], kind).schema
    kept, fields = [c for c in rows.columns if c != column], made_fields.names
    schema = StructType([*rows.select(*kept).schema.fields, *made_fields.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            made = [f(x) for x in batch.column(column).to_pylist()]
            cols = [batch.column(c) for c in kept] + [pa.array([m[k] for m in made], arrow.field(k).type) for k in fields]
            yield pa.RecordBatch.from_arrays([x.cast(arrow.field(n).type) for n, x in zip([*kept, *fields], cols, strict=True)], names=[*kept, *fields])

    return rows.mapInArrow(run, schema)


def conversation_blocks(rows: DataFrame, rules: list[tuple[str, str]], strings: DataFrame) -> DataFrame:
    """conv_id, block of each conversation, multiplied in a tree over the segments of its rows."""
    grammar: list[Grammar] = []

    def own(symbols: str) -> dict:
        if not grammar:
            grammar.append(Grammar(rules))
        return as_row(grammar[0].block(symbols))

    def joined(parts: list[dict]) -> dict:
        out = from_row(parts[0]["block"])
        for p in parts[1:]:
            out = out @ from_row(p["block"])
        return as_row(out)

    packed = lambda df: df.select("conv_id", "segment", F.struct("first", "last", "illegal", "cells").alias("block"))
    blocks = packed(added(strings, "symbols", BLOCK, own))
    last = rows.agg(F.max("number").alias("n")).first().n or 0
    groups = last // SEGMENT + 1
    while groups > 1:
        groups = -(-groups // FAN)
        grouped = blocks.groupBy("conv_id", F.floor(F.col("segment") / FAN).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))
        blocks = packed(added(grouped, "parts", BLOCK, joined))  # FAN blocks at most
    return blocks.select("conv_id", "block")


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit of each conversation that has rows; rows as ``faults`` gives them."""
    cut = F.floor(F.col("number") / SEGMENT)
    ordered = F.array_sort(F.collect_list(F.struct("number", "symbol")))  # SEGMENT symbols at most
    strings = settle(rows.groupBy("conv_id", cut.alias("segment")).agg(F.array_join(F.transform(ordered, lambda x: x.symbol), "").alias("symbols")), "symbols")
    rules = learn_rules(settle(strings.select("symbols").distinct(), "strings"))

    def read(block: dict) -> dict:
        cost, audit = best_audit(from_row(block))
        return {"illegal": block["illegal"], "cost": cost, "audit": audit}

    return added(conversation_blocks(rows, rules, strings), "block", "illegal long, cost long, audit string", read)


REPAIRED = "number long, edit string, role string, text string"


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, number, edit, role, text of the rows after the edits of each audit, in order within their partition.

    Conversations are dealt to tasks and read front to back, the audit before
    the rows, so that no more than the batch at hand is held.
    """
    kind = rows.schema["conv_id"].dataType
    lead = found.select("conv_id", F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "audit")
    both = lead.unionByName(rows.select("conv_id", "number", "role", "text", F.lit(None).cast("string").alias("audit")))
    ordered = both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = at = audit = None
        place = state = rows_end = 0

        def until_row(out: list[tuple]) -> None:
            """Emit insertions up to the next edit of a row."""
            nonlocal place, state
            while place < len(audit) and audit[place] == "I":
                state = 3 if state == 2 else 2
                out.append((conv, at, "I", NAMES[state], ""))
                place += 1

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "number", "edit", "role", "text"])

        types = None
        for batch in batches:
            types = types or [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string()]
            out: list[tuple] = []
            for key, number, role, text, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number is None:
                    conv, audit, place, state, rows_end = key, more, 0, 0, len(more.rstrip("I"))
                    continue
                at = number
                until_row(out)
                edit = audit[place]
                place += 1
                if edit == "K":
                    state = EMITS[role[:1]][state]
                    out.append((conv, number, edit, role, text))
                elif edit == "R":
                    state = 3 if state == 2 else 2
                    out.append((conv, number, edit, NAMES[state], text))
                if place == rows_end:
                    until_row(out)  # insertions behind the last row
            if out:
                yield batch_of(out)

    rest = rows.sparkSession.createDataFrame([], REPAIRED).schema
    return ordered.mapInArrow(run, StructType([StructField("conv_id", kind), *rest.fields]))


def text_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 over ``role:text`` of the rows as they stand, joined by line feeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, kind = None, None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["conv_id", "sha256"])
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if digest is not None and key == conv:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        yield give()
                    conv, digest = key, hashlib.sha256()
                digest.update(f"{role}:{text}".encode())
        if digest is not None:
            yield give()

    return repaired.mapInArrow(run, StructType([StructField("conv_id", repaired.schema["conv_id"].dataType), StructField("sha256", StringType())]))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by rule: the checksum of ``conv_id:turn`` modulo 20 drops, empties, cuts, repeats or mislabels a row."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", one_space("role").alias("role"), one_space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repair(rows: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """Report on each of ``conv_ids``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    marked = faults(rows)
    found = settle(audits(marked), "audits")
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = marked.groupBy("conv_id").agg(gaps, count("blank"), count("duplicate"), count("truncated"))
    out = conv_ids.select("conv_id").distinct().withColumnRenamed("conv_id", "of")
    for part in (counts, found, text_digests(repaired_rows(marked, found))):
        out = out.join(part, F.col("of").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("of").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
