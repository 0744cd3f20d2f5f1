"""Byte-level BPE encoding and decoding over overlapping chunks.

A text is cut into chunks of ``CHUNK`` characters that overlap by ``OVERLAP``, which are
pre-tokenised each from its own first character on; those of a text of more than
``SPREAD`` characters wherever Spark puts them, in larger chunks of that size. A pre-token depends on
nothing before it, so as soon as two neighbours share a boundary in their
overlap they agree from there on: the text's pre-tokens are the left chunk's up
to the first shared boundary and the right one's after it. Where an overlap has
no shared boundary (one pre-token may be as long as it likes) the two chunks are
joined and pre-tokenised anew from the left one's last sure boundary, and then twice
as many each time. The pieces are then encoded by the ranks; decoding concatenates the tokens' raw bytes.

Edge cases: null and empty texts have no ids and decode to nothing; repeated
rows are encoded each by itself, ties cannot arise; null ids are kept; an empty table gives no
rows; other columns are ignored, whatever their names; strings of special tokens
are ordinary text. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilesieve.llm.common import keyed_text, map_rows

CHUNK = 1 << 11
OVERLAP = 1 << 7
SPREAD = 1 << 16
CACHE = 300_000
AHEAD = 4  # characters after a match that the pattern may look at


class Codec(dict):
    """Ids of pre-tokens by the ranks, a bounded number of them remembered."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern).finditer
        self.findall = regex.compile(pattern).findall
        self.merge = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.raw[rank] = token

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[piece] = np.array(self.merge(piece.encode()), "<u4").tobytes()
        return ids

    def encode(self, pre_tokens: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, pre_tokens))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def boundaries(own: Codec, text: str) -> list[int]:
    """Where the pre-tokens of a chunk begin."""
    return [m.start() for m in own.find(text)]


def chunk_places(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the chunks of ``n`` characters."""
    count = max(1, -(-n // chunk))
    return [(k * chunk, min(n, (k + 1) * chunk + overlap)) for k in range(count)]


def stitch(own: Codec, chunks: list[tuple[int, str, list[int]]]) -> list[str]:
    """The text's pre-tokens, from the chunks' (place, text, boundaries) in order."""
    out: list[str] = []

    def emit(text: str, starts: list[int], low: int, high: int | None) -> None:
        """Pre-tokens of ``text`` from boundary ``low`` up to ``high``, or all to the end."""
        some = starts[bisect_left(starts, low) : None if high is None else bisect_left(starts, high)]
        ends = [*some[1:], len(text) if high is None else high]
        out.extend(text[a:b] for a, b in zip(some, ends))

    place, text, starts = chunks[0]
    low = 0  # what is to come of the left chunk, from here
    at, more = 1, 1
    while at < len(chunks):
        nxt_place, nxt_text, nxt_starts = chunks[at]
        # a boundary is sure where the pattern could see what follows the match before it
        sure = starts[: bisect_left(starts, len(text) - AHEAD + 1)]
        shift = nxt_place - place
        theirs = set(nxt_starts)
        shared = next((p for p in sure[bisect_left(sure, max(shift, low)) :] if p - shift in theirs), None)
        if shared is not None:
            emit(text, starts, low, shared)
            place, text, starts, low = nxt_place, nxt_text, nxt_starts, shared - shift
            at, more = at + 1, 1
            continue
        last = max(low, sure[-1] if sure else low)
        emit(text, starts, low, last)
        # twice as many chunks each time, so that one pre-token over all of them is read in linear time
        parts, end = [text[last:]], place + len(text)
        for p, t, _ in chunks[at : at + more]:
            parts.append(t[end - p :])
            end = p + len(t)
        text = "".join(parts)
        place, starts, low = place + last, boundaries(own, text), 0
        at, more = at + more, more * 2
    emit(text, starts, low, None)
    return out


def pre_tokens(own: Codec, text: str, chunk: int, overlap: int) -> list[str]:
    """A text's pre-tokens by way of its chunks."""
    if len(text) <= chunk:
        return own.findall(text)
    return stitch(own, [(a, text[a:b], boundaries(own, text[a:b])) for a, b in chunk_places(len(text), chunk, overlap)])


def _chunked(docs: DataFrame, chunk: int, overlap: int, own_codec) -> DataFrame:
    """``(key, id, k, place, text, starts)``: long texts' chunks, pre-tokenised apart."""
    long = docs.withColumn("key", F.struct("id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at")))
    count = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    each = long.select("key", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"), "text")
    each = each.select(F.col("key.id").alias("id"), F.col("key.h").alias("h"), F.col("key.at").alias("at"), "k", F.expr(f"substring(text, k * {chunk} + 1, {chunk + overlap})").alias("text"))

    def start():
        own = own_codec()

        def step(ids, hashes, ats, ks, texts):
            return [ids, hashes, ats, ks, texts, [boundaries(own, t) for t in texts]]

        return step

    return map_rows(each.repartition("id", "h", "at", "k"), "id bigint, h bigint, at bigint, k int, text string, starts array<int>", start)


def _each_text(docs: DataFrame, path: str, pattern: str, schema: str, result, id_col: str, text_col: str, chunk: int, overlap: int, spread: int) -> DataFrame:
    """``id`` and ``result(codec, id bytes)`` for every row."""
    frame = keyed_text(docs, id_col, text_col)

    def start():
        own = codec(path, pattern)

        def step(ids, texts):
            return [ids, *map(list, zip(*(result(own, own.encode(pre_tokens(own, t, chunk, overlap))) for t in texts)))]

        return step

    arrow = None

    def join(table: pa.Table) -> pa.Table:
        own = codec(path, pattern)
        rows = sorted(zip(table["k"].to_pylist(), table["text"].to_pylist(), table["starts"].to_pylist()))
        found = result(own, own.encode(stitch(own, [(k * spread, t, s) for k, t, s in rows])))
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip([table["id"][0].as_py(), *found], arrow)], schema=arrow)

    short = map_rows(frame.where(F.length("text") <= spread), f"id bigint, {schema}", start)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(short.schema)
    long = _chunked(frame.where(F.length("text") > spread), spread, overlap, lambda: codec(path, pattern)).groupBy("id", "h", "at").applyInArrow(join, short.schema)
    return short.union(long).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """``(id, ids)``."""
    return _each_text(docs, path, pattern, "ids array<int>", lambda own, ids: (np.frombuffer(ids, "<i4"),), id_col, text_col, chunk, overlap, spread)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)``: the raw bytes of the ids."""

    def start():
        own = codec(path, pattern)

        def step(keys, ids):
            return [keys, [own.decode(np.array(x or [], "<u4").tobytes()) for x in ids]]

        return step

    frame = tokens.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_rows(frame, "id bigint, bytes binary", start).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)``: digests of the ids and of what they decode to."""

    def digests(own: Codec, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return _each_text(docs, path, pattern, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", digests, id_col, text_col, chunk, overlap, spread)
