"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids with an end mark; those longer than a sequence are
cut into pieces of a whole sequence behind a first piece with the rest. Whole
pieces are sequences of their own. The others are dealt at random into blocks of
about ``BLOCK`` pieces; the blocks are what one task ever holds, so the work
grows with the input while a task's memory does not.

For each block ``ISLANDS`` populations evolve apart. A chromosome is a grouping
of the block's pieces into sequences. Crossover injects whole well-filled
sequences of one parent into the other, removes the other's sequences that hold
pieces now present twice, and best-fits the displaced pieces, longest first;
mutation dissolves the worst-filled sequences and groups their pieces anew, by turns
by best fit and by a search for the pieces that fill each sequence most. After each epoch the islands of a block pass their elite on in a ring, by a shuffle.
Then each block's best grouping counts. As blocks are packed apart, each has a
few sequences with room left; their pieces are dealt into new blocks and evolve
once more, until what is left in this way fits one block or no longer shrinks.

Every step that depends on task order is written to the shared folder, so a lost
executor never changes what later steps see.

Edge cases: null and empty texts give one piece with the end mark alone;
repeated rows are packed each by itself; null ids are kept; an empty table gives
no rows; other columns are ignored, whatever their names; ties between groupings
go to the smaller island. Texts are encoded whole; a string of an added token of
the file is that token, as the library has it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilesieve.llm.common import keyed_text, map_rows
from tilesieve.plans.shared import discard, materialize

BLOCK = 4096
ISLANDS = 4
POPULATION = 4
EPOCHS = 3
GENERATIONS = 8
ROUNDS = 4

#: The pre-token pattern of byte-level vocabularies of the GPT-2 kind.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "It's a probe, isn't it? We'll see: 12345 naïve façades;\nÜber-große Straße <|endoftext|> — 日本語のテキスト ... (x_1+y^2)=z!! don'T"

#: GPT-2's map of bytes to printable characters: printable Latin-1 stands for itself, the rest follows from 256 on.
_printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
_as_char = {b: chr(b) for b in _printable} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - _printable))}
_as_byte = {c: b for b, c in _as_char.items()}
_plain = "[!-~¡-ɏ]"  # no white space in any version of Unicode
_safe_cut = re.compile(f"(?<={_plain}) (?={_plain})")
_unusual = re.compile(r"[^\S \n]")


class Encoder:
    """Ids of texts as the ``tokenizers`` library gives them, as little-endian 32-bit integers.

    The vocabulary's own pattern and ranks (its ids are in the order of its merges)
    are run by ``tiktoken``, several times as fast as the library; texts with unusual
    white space go through the library itself. Texts are split at added tokens first,
    the leftmost and longest, as the library does. The two must agree on a probe
    before an encoder is used.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        vocabulary = given["model"]["vocab"]
        added = given.get("added_tokens") or []
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take more than their own characters")
        self.added = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        ranks = {bytes(map(_as_byte.__getitem__, token)): rank for token, rank in vocabulary.items() if _as_byte.keys() >= set(token)}
        self.fast = tiktoken.Encoding("same", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        if self.encode(PROBE) != self.whole(PROBE):
            raise ValueError(f"{path} is not a byte-level vocabulary whose ids are in the order of its merges")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.at_added is not None and self.at_added.search(text):
            return b"".join(self.added[x] if k % 2 else self._between(x) for k, x in enumerate(self.at_added.split(text)))
        return self._between(text)

    def _between(self, text: str) -> bytes:
        if not text:
            return b""
        if _unusual.search(text):
            first, *rest = _safe_cut.split(text)  # a pre-token never runs across a space that follows a visible character
            return self.whole(first) + b"".join(self.whole(" " + x) for x in rest)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    rest = n % capacity
    starts = ([0] if rest else []) + list(range(rest, n, capacity))
    return [(s, (rest if s == 0 and rest else capacity)) for s in starts]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``."""

    def start():
        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()

        def step(ids, texts):
            out: list[tuple] = []
            for key, text in zip(ids, texts):
                data = encode(text) + end
                for k, (at, n) in enumerate(cut(len(data) // 4, capacity)):
                    part = data[4 * at : 4 * (at + n)]
                    out.append((key, k, at, n, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if with_ids else [])))
            return list(map(list, zip(*out)))

        return step

    schema = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return map_rows(keyed_text(docs, id_col, text_col), schema, start)


class Rooms:
    """Sequences by the room they have left; finds the tightest fit in constant time."""

    def __init__(self, capacity: int):
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def put(self, seq: int, room: int) -> None:
        self.by_room[room].append(seq)
        self.mask |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        rest = self.mask >> size
        if not rest:
            return None
        room = size + (rest & -rest).bit_length() - 1
        seq = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return seq, room


def best_fit(sizes: list[int], order: list[int], group: np.ndarray, rooms: Rooms, first_new: int, capacity: int) -> int:
    """Place the pieces in this order into ``group``; the number of the next new sequence."""
    for i in order:
        size = sizes[i]
        found = rooms.take(size)
        if found is None:
            seq, room = first_new, capacity
            first_new += 1
        else:
            seq, room = found
        group[i] = seq
        if room > size:
            rooms.put(seq, room - size)
    return first_new


@dataclass
class Evolution:
    """One island: groupings of one block's pieces."""

    lengths: np.ndarray
    capacity: int
    random: np.random.Generator

    def __post_init__(self):
        self.sizes = self.lengths.tolist()

    def fresh(self, noise: float) -> np.ndarray:
        group = np.empty(len(self.sizes), np.int32)
        key = -self.lengths * (1 + noise * self.random.standard_normal(len(self.sizes)))
        best_fit(self.sizes, np.argsort(key, kind="stable").tolist(), group, Rooms(self.capacity), 0, self.capacity)
        return group

    def searched(self, displaced: np.ndarray, group: np.ndarray, first_new: int) -> None:
        """Group the displaced pieces into new sequences, each begun by the longest piece left
        and completed by the one or two that leave the least room."""
        order = displaced[np.argsort(self.lengths[displaced], kind="stable")]
        by_size: dict[int, list[int]] = {}
        for i in order.tolist():
            by_size.setdefault(self.sizes[i], []).append(i)
        left = np.bincount(self.lengths[displaced], minlength=self.capacity + 1)

        def take(size: int) -> int:
            left[size] -= 1
            group[by_size[size].pop()] = first_new
            return size

        for _ in range(len(displaced)):
            some = np.flatnonzero(left)
            if not len(some):
                break
            room = self.capacity - take(int(some[-1]))
            while room > 0:
                some = np.flatnonzero(left[: room + 1])
                if not len(some):
                    break
                # the largest size up to each, for the second piece of a pair
                upto = np.zeros(room + 1, np.int64)
                upto[some] = some
                upto = np.maximum.accumulate(upto)
                other = upto[room - some]
                other[(other == some) & (left[some] < 2)] = 0
                sums = some + other
                best = int(sums.argmax())
                if room - int(sums[best]) >= int(some[0]):
                    room -= take(int(some[-1]))  # more than two fit: the largest first
                    continue
                take(int(some[best]))
                if other[best]:
                    take(int(other[best]))
                break
            first_new += 1

    def filled(self) -> np.ndarray:
        """All pieces grouped by that search."""
        group = np.empty(len(self.sizes), np.int32)
        self.searched(np.arange(len(self.sizes)), group, 0)
        return group

    def fitness(self, group: np.ndarray) -> tuple[int, float]:
        """Fewer sequences first, then fuller ones and emptier ones (Falkenauer); larger is better."""
        fill = np.bincount(group, self.lengths)
        fill = fill[fill > 0] / self.capacity
        return -len(fill), float((fill**2).sum())

    def place(self, group: np.ndarray, displaced: np.ndarray) -> np.ndarray:
        """Best-fit the displaced pieces, longest first, and number the sequences anew."""
        group[displaced] = -1
        stay = group >= 0
        fill = np.bincount(group[stay], self.lengths[stay]).astype(np.int64) if stay.any() else np.zeros(0, np.int64)
        rooms = Rooms(self.capacity)
        for seq in np.flatnonzero((fill > 0) & (fill < self.capacity)).tolist():
            rooms.put(seq, self.capacity - int(fill[seq]))
        order = displaced[np.argsort(-self.lengths[displaced] + self.random.random(len(displaced)) * 0.5, kind="stable")]
        best_fit(self.sizes, order.tolist(), group, rooms, len(fill), self.capacity)
        return np.unique(group, return_inverse=True)[1].astype(np.int32)

    def crossover(self, mother: np.ndarray, father: np.ndarray) -> np.ndarray:
        fill = np.bincount(father, self.lengths)
        full = np.flatnonzero(fill >= self.capacity - self.random.integers(0, 4))
        if not len(full):
            full = np.array([int(fill.argmax())])
        some = full[self.random.random(len(full)) < self.random.uniform(0.1, 0.5)]
        injected = np.isin(father, some if len(some) else full[:1])
        twice = np.unique(mother[injected])
        child = mother.copy()
        child[injected] = father[injected] + (mother.max() + 1)
        return self.place(child, np.flatnonzero(np.isin(mother, twice) & ~injected))

    def mutate(self, group: np.ndarray) -> np.ndarray:
        fill = np.bincount(group, self.lengths)
        room = self.capacity - fill
        odds = np.where(fill > 0, room + 0.05, 0)
        n = min(int((odds > 0).sum()), max(2, int(self.random.integers(2, 2 + len(fill) // 20 + 1))))
        gone = self.random.choice(len(fill), n, replace=False, p=odds / odds.sum())
        displaced = np.flatnonzero(np.isin(group, gone))
        if self.random.random() < 0.5:
            return self.place(group.copy(), displaced)
        child = group.copy()
        self.searched(displaced, child, int(group.max()) + 1)
        return np.unique(child, return_inverse=True)[1].astype(np.int32)

    def run(self, population: list[np.ndarray], generations: int) -> list[np.ndarray]:
        """Tournament of parents, the worst gives way; the best is first and never lost."""
        least = -int(-self.lengths.sum() // self.capacity)
        scored = sorted(((self.fitness(g), i, g) for i, g in enumerate(population)), key=lambda x: (x[0], -x[1]), reverse=True)
        count = len(scored)
        for _ in range(generations):
            if -scored[0][0][0] <= least:
                break
            a, b = self.random.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
            child = self.crossover(scored[a][2], scored[b][2]) if a != b else scored[a][2]
            child = self.mutate(child)
            count += 1
            scored.append((self.fitness(child), count, child))
            scored.sort(key=lambda x: (x[0], -x[1]), reverse=True)
            scored.pop()
        return [g for _, _, g in scored]


def _evolve(state: DataFrame, capacity: int, population: int, generations: int, epoch: int) -> DataFrame:
    """One epoch of every island: its population, then its elite and the elite's fitness."""

    def run(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        lengths = np.array(row["lengths"], np.int64)
        island = Evolution(lengths, capacity, np.random.default_rng([row["block"], row["island"], epoch]))
        groups = [np.array(g, np.int32) for g in row["population"]]
        if not groups:
            # the first of each block is plain best fit, longest first; each island has one searched grouping
            groups = [island.fresh(0.0 if row["island"] == 0 and i == 0 else 0.02 * (row["island"] + 1) * (i + 1)) for i in range(population - 1)] + [island.filled()]
        elif row["migrant"] is not None:
            groups[-1] = np.array(row["migrant"], np.int32)
        groups = island.run(groups, generations)
        fitness = island.fitness(groups[0])
        out = {"block": [row["block"]], "island": [row["island"]], "lengths": [row["lengths"]], "population": [[g.tolist() for g in groups]], "elite": [groups[0].tolist()], "sequences": [-fitness[0]], "fullness": [fitness[1]]}
        return pa.Table.from_pydict(out, schema=arrow)

    arrow = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int32())), ("population", pa.list_(pa.list_(pa.int32()))), ("elite", pa.list_(pa.int32())), ("sequences", pa.int32()), ("fullness", pa.float64())])
    schema = "block bigint, island int, lengths array<int>, population array<array<int>>, elite array<int>, sequences int, fullness double"
    return state.groupBy("block", "island").applyInArrow(run, schema)


def _ring(state: DataFrame) -> DataFrame:
    """Every island gets the elite of the one before it."""
    blocks = Window.partitionBy("block").orderBy("island")
    last = F.last("elite").over(blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return state.select("block", "island", "lengths", "population", F.coalesce(F.lag("elite").over(blocks), last).alias("migrant"))


def _pack_blocks(items: DataFrame, n_blocks: int, capacity: int, islands: int, population: int, epochs: int, generations: int, salt: int) -> DataFrame:
    """``(row_id, length, block, seq, fill)`` of pieces shorter than a sequence."""
    spread = F.pmod(F.xxhash64("row_id", F.lit(salt)), F.lit(n_blocks)).alias("block")
    blocks = items.select("row_id", F.col("length").cast("int").alias("length"), spread).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "row_id")), asc=False).alias("items"))
    blocks = materialize(blocks.select("block", F.col("items.length").alias("lengths"), F.col("items.row_id").alias("row_ids")), "blocks")
    state = blocks.select("block", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), "lengths", F.array().cast("array<array<int>>").alias("population"), F.lit(None).cast("array<int>").alias("migrant"))
    old = None
    for epoch in range(epochs):
        new = materialize(_evolve(state, capacity, population, generations, epoch), "islands")
        if old is not None:
            discard(old)
        old, state = new, _ring(new)
    rank = F.struct("sequences", (-F.col("fullness")).alias("emptiness"), "island")
    best = old.groupBy("block").agg(F.min_by("elite", rank).alias("elite"))
    each = blocks.join(best, "block").select("block", F.explode(F.arrays_zip("row_ids", "lengths", "elite")).alias("x")).select("block", F.col("x.row_ids").alias("row_id"), F.col("x.lengths").alias("length"), F.col("x.elite").alias("seq"))
    mates = Window.partitionBy("block", "seq")
    out = materialize(each.withColumn("fill", F.sum("length").over(mates)), "packed")
    discard(old, blocks)
    return out


def pack_items(items: DataFrame, capacity: int, block: int = BLOCK, islands: int = ISLANDS, population: int = POPULATION, epochs: int = EPOCHS, generations: int = GENERATIONS, rounds: int = ROUNDS) -> DataFrame:
    """``(row_id, sequence_id, offset)`` of pieces ``(row_id, length)``, each shorter than a sequence."""
    left, done, waiting = items, [], items.count()
    for k in range(rounds):
        if not waiting:
            break
        n_blocks = -(-waiting // block)
        packed = _pack_blocks(left, n_blocks, capacity, islands, population, epochs, generations, k)
        packed = packed.withColumn("sequence_id", (F.lit(k) * n_blocks_bound + F.col("block")) * F.lit(1 << 20) + F.col("seq"))
        again = packed.where(F.col("fill") < capacity)
        n_again = again.count() if n_blocks > 1 and k + 1 < rounds else 0
        if n_again >= waiting or not n_again:
            done.append(packed)
            break
        done.append(packed.where(F.col("fill") >= capacity))
        left, waiting = again, n_again
    if not done:
        return items.select("row_id", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")).limit(0)
    every = done[0].select("row_id", "length", "sequence_id")
    for d in done[1:]:
        every = every.union(d.select("row_id", "length", "sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "row_id").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("row_id", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"))


n_blocks_bound = 1 << 38  # block numbers of a round stay below it


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **how: int) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``, a row a piece."""
    every = pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids).withColumn("row_id", F.monotonically_increasing_id())
    every = materialize(every, "pieces")
    placed = pack_items(every.where(F.col("length") < capacity).select("row_id", "length"), capacity, **how)
    full = every.where(F.col("length") >= capacity).select("*", (-1 - F.col("row_id")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = every.where(F.col("length") < capacity).join(placed, "row_id").select(full.columns)
    return full.union(rest).drop("row_id").withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of pieces packed ``with_ids``: the training sequences."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p.ids)).alias("ids"))
