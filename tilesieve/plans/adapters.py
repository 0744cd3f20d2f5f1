"""Reads made from the generic tables, in integer arithmetic only, so that any engine
makes the same ones. The SQL beside each says the same."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz "
BASES = "ACGTACGTACGTACGTACGTACGTACG"
QUALS = "I?5+IDI:I?I5III?ID+I:III5II"
CYCLES = 60
R1 = 36
SEED = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placed reads: a lane an event type, four tiles, coordinates by index."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("pair_index"),
        F.col("event_type").alias("lane"),
        (F.lit(1101) + F.col("user_id") % 4).cast("int").alias("tile"),
        (F.col("event_id") * 7919 % 30011).cast("int").alias("x"),
        (F.col("event_id") * 104729 % 24007).cast("int").alias("y"),
        F.floor(F.col("value") * 100).cast("bigint").alias("quality_sum"),
        "user_id",
    )


EVENT_READS = """reads as (select event_id as pair_index, event_type as lane, cast(1101 + user_id % 4 as int) as tile,
  cast(event_id * 7919 % 30011 as int) as x, cast(event_id * 104729 % 24007 as int) as y,
  cast(floor(value * 100) as bigint) as quality_sum, user_id from events)"""

#: Tiles 1101 to 1104: surface 1, one swath, rows by rank.
LAYOUT = """layout as (select tile, 1 as surface, cast(dense_rank() over (order by tile // 100 % 10) - 1 as int) as col,
  cast(dense_rank() over (order by tile % 100) - 1 as int) as row from (select distinct tile from reads))"""

PLACED = f"""{EVENT_READS}, {LAYOUT}, box as (select min(x) as x0, max(x) - min(x) + 1 as cx, min(y) as y0, max(y) - min(y) + 1 as cy from reads),
placed as (select pair_index, lane, reads.tile, x, y, quality_sum, user_id, surface, col, row,
  cast(col * cx + x - x0 as bigint) as gx, cast(row * cy + y - y0 as bigint) as gy from reads join layout using (tile), box)"""


def event_edges(reads: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs of one user's events of one type, as candidate pairs; (l, r) makes the id.

    ``carry``: attributes of both ends that come along, as ``l_`` and ``r_``, so that pairs,
    of which there are many more than reads, need not be shuffled to fetch them.
    """
    a, b = (reads.select(F.col("pair_index").alias(end), "lane", "user_id", *(F.col(c).alias(f"{end}_{c}") for c in carry)) for end in "lr")
    return a.join(b, ["lane", "user_id"]).where("l < r").select("l", "r", (F.col("l") * 1_000_000 + F.col("r")).alias("edge_id"), *(f"{end}_{c}" for end in "lr" for c in carry))


EDGES = """edges as (select a.pair_index as l, b.pair_index as r, a.pair_index * 1000000 + b.pair_index as edge_id
  from placed a join placed b on a.lane = b.lane and a.user_id = b.user_id and a.pair_index < b.pair_index)"""


def document_letters(text: Column) -> tuple[Column, Column]:
    """Bases and qualities made from all of a text's letters."""
    part = F.lower(text)
    bases = F.regexp_replace(F.translate(part, LETTERS, BASES), "[^ACGT]", "N")
    quals = F.translate(F.regexp_replace(part, "[^a-z ]", "!"), LETTERS, QUALS)
    return bases, quals


def whole_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of one letter and more as one sequence of all its letters, a lane a language."""
    bases, quals = document_letters(F.col("text"))
    d = table(spark, sf_dir, "documents").where("length(text) > 0")
    return d.select(F.col("doc_id").alias("pair_index"), F.col("lang").alias("lane"), bases.alias("bases"), quals.alias("quals"))


#: Bytes of letters in a batch of reads.
BATCH = 4 << 20


def _letter_table(letters: str, other: str) -> bytes:
    table = bytearray(other.encode() * 256)
    for a, b in zip(LETTERS, letters):
        table[ord(a)] = ord(b)
    return bytes(table)


def text_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole texts as consecutive reads of ``CYCLES`` letters; a text's last read may be shorter.

    ``pair_index`` is ``doc_id * 2**26 + position``: no string has 2**26 reads, and ids may have 37 bits.
    The letters are those of ``document_letters``, by tables over whole texts: a symbol outside
    Latin-1 is one unknown letter like any other.
    """
    to_bases, to_quals = _letter_table(BASES, "N"), _letter_table(QUALS, "!")
    d = table(spark, sf_dir, "documents").where("length(text) > 0")

    def cut(ids: list, lanes: list, texts: list[bytes]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in texts])
        counts = -(-sizes // CYCLES)
        owner = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        offsets = np.append(np.repeat(np.cumsum(sizes) - sizes, counts) + nth * CYCLES, sizes.sum()).astype(np.int32)
        joined = b"".join(texts)
        columns = [pa.StringArray.from_buffers(len(owner), pa.py_buffer(offsets), pa.py_buffer(joined.translate(t))) for t in (to_bases, to_quals)]
        known = np.array([i is not None for i in ids])[owner]
        index = (np.array([i or 0 for i in ids], np.int64)[owner] << 26) + nth
        return pa.RecordBatch.from_arrays([pa.array(index, mask=~known), pa.array(lanes, pa.string()).take(pa.array(owner)), *columns], names=["pair_index", "lane", "bases", "quals"])

    def run(batches):
        for batch in batches:
            waiting, size = ([], [], []), 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for kept, value in zip(waiting, (*row[:2], row[2].lower().encode("latin-1", "replace"))):
                    kept.append(value)
                size += len(waiting[2][-1])
                if size >= BATCH:
                    yield cut(*waiting)
                    waiting, size = ([], [], []), 0
            if size:
                yield cut(*waiting)

    return d.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "pair_index bigint, lane string, bases string, quals string")


def repeated_texts(spark: SparkSession, sf_dir: str) -> bool:
    """Whether a document's id occurs twice, and so those of its reads."""
    return bool(whole_letters(spark, sf_dir).groupBy("pair_index").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


LETTER_SQL = f"""letters as (select doc_id as pair_index, lang as lane,
  regexp_replace(translate(lower(text), '{LETTERS}', '{BASES}'), '[^ACGT]', 'N', 'g') as bases,
  translate(regexp_replace(lower(text), '[^a-z ]', '!', 'g'), '{LETTERS}', '{QUALS}') as quals
  from documents where length(text) > 0)"""

READ_SQL = f"""{LETTER_SQL}, reads as (select pair_index * {2**26} + nth as pair_index, lane, substr(bases, cast(nth * {CYCLES} + 1 as bigint), {CYCLES}) as bases,
  substr(quals, cast(nth * {CYCLES} + 1 as bigint), {CYCLES}) as quals from (select *, unnest(range(0, (length(bases) + {CYCLES - 1}) // {CYCLES})) as nth from letters))"""


def exact_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reads of the exact-match mode; one in fifty has no location."""
    d = table(spark, sf_dir, "documents")
    placed = F.col("doc_id") % 50 != 49
    return d.select(
        F.col("doc_id").alias("pair_index"),
        F.sha2("text", 256).alias("signature"),
        F.when(placed, F.concat(F.lit("run:"), (F.lit(1101) + F.col("doc_id") % 2).cast("string"))).alias("location"),
        (F.col("doc_id") * 7919 % 997).cast("int").alias("x"),
        (F.col("doc_id") * 104729 % 991).cast("int").alias("y"),
        F.col("n_chars").alias("quality_score"),
        F.concat(F.lit("read"), F.col("doc_id").cast("string")).alias("read_name"),
    )


EXACT_READS = """reads as (select doc_id as pair_index, sha256(text) as signature,
  case when doc_id % 50 <> 49 then 'run:' || cast(1101 + doc_id % 2 as varchar) end as location,
  cast(doc_id * 7919 % 997 as int) as x, cast(doc_id * 104729 % 991 as int) as y, n_chars as quality_score,
  'read' || cast(doc_id as varchar) as read_name from documents)"""


def p_values(spark: SparkSession, sf_dir: str, grid: int = 997) -> DataFrame:
    """Hypotheses with p-values on a grid, many of them tied."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        (((F.col("event_id") * 7919 + F.col("user_id") * 31) % grid + 1).cast("double") / F.lit(float(grid + 1))).alias("p"),
        ((F.col("event_id") % 89 + 1).cast("double") / 90.0).alias("posterior"),
        ((F.col("event_id") % 53 + 1).cast("double") / 54.0).alias("compatibility_p"),
    )


def p_values_sql(grid: int = 997) -> str:
    return f"""tests as (select event_id as id, cast((event_id * 7919 + user_id * 31) % {grid} + 1 as double) / {grid + 1}.0::double as p,
  cast(event_id % 89 + 1 as double) / 90.0::double as posterior, cast(event_id % 53 + 1 as double) / 54.0::double as compatibility_p from events)"""


def permuted_p_values(spark: SparkSession, sf_dir: str, replicates: int) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    return e.select("replicate", (((F.col("event_id") * 104729 + F.col("replicate") * 613) % 1009 + 1).cast("double") / 1010.0).alias("p"))


def permuted_sql(replicates: int) -> str:
    return f"""permuted as (select replicate, cast((event_id * 104729 + replicate * 613) % 1009 + 1 as double) / 1010.0::double as p
  from events, (select unnest(range(1, {replicates + 1})) as replicate))"""


def permuted_distances(spark: SparkSession, sf_dir: str, replicates: int) -> DataFrame:
    """Nearest distances of shuffled replicates."""
    e = table(spark, sf_dir, "events").select("event_id", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    return e.select("replicate", ((F.col("event_id") * 613 + F.col("replicate") * 7919) % 30011).cast("double").alias("nearest_distance"))


def permuted_distances_sql(replicates: int) -> str:
    return f"""shuffled as (select replicate, cast((event_id * 613 + replicate * 7919) % 30011 as double) as nearest_distance
  from events, (select unnest(range(1, {replicates + 1})) as replicate))"""


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consecutive reads of all texts as pairs of one length each, with names that say a place."""
    r = text_reads(spark, sf_dir)
    place = F.concat_ws(":", F.lit("run"), "lane", (F.lit(1101) + F.col("pair_index") % 4).cast("string"), (F.col("pair_index") % 30011).cast("string"), (F.col("pair_index") % 24007).cast("string"))
    return r.select("pair_index", place.alias("name"), F.rpad("bases", CYCLES, "N").alias("bases"), F.rpad("quals", CYCLES, "!").alias("quals"))


SEQUENCED = f"""{READ_SQL}, sequenced as (select row_number() over (order by pair_index) - 1 as pair_index, 'run:' || lane || ':' || cast(1101 + pair_index % 4 as varchar) || ':' || cast(pair_index % 30011 as varchar) || ':' || cast(pair_index % 24007 as varchar) as name,
  'run:' || lane as lane, cast(1101 + pair_index % 4 as int) as tile, cast(pair_index % 30011 as int) as x, cast(pair_index % 24007 as int) as y, rpad(bases, {CYCLES}, 'N') as bases, rpad(quals, {CYCLES}, '!') as quals from reads)"""


def truth_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A truth table: a fifth of the reads are children of one of the three before them."""
    e = table(spark, sf_dir, "events")
    child = (F.col("event_id") % 10 < 2) & (F.col("event_id") > 2)
    kind = F.when(child, "optical").when(F.col("event_id") % 10 == 5, "pcr").when(F.col("event_id") % 100 == 7, "polyg").otherwise("unique")
    parent = F.when(child, F.concat(F.lit("r"), (F.col("event_id") - 1 - F.col("user_id") % 3).cast("string"))).otherwise("NA")
    return e.select(
        (F.col("event_id") + 1).alias("emitted_rank"),
        F.concat(F.lit("r"), F.col("event_id").cast("string")).alias("read_name"),
        F.col("event_id").alias("molecule"),
        kind.alias("mechanism"),
        parent.alias("parent_read_name"),
        (child & (F.col("user_id") % 4 == 0)).cast("int").alias("cross_tile"),
        (F.floor(F.col("value") * 100) % 5 != 0).alias("stays"),
    )


TRUTH = """truth as (select event_id + 1 as emitted_rank, 'r' || cast(event_id as varchar) as read_name,
  case when event_id % 10 < 2 and event_id > 2 then 'optical' when event_id % 10 = 5 then 'pcr' when event_id % 100 = 7 then 'polyg' else 'unique' end as mechanism,
  case when event_id % 10 < 2 and event_id > 2 then 'r' || cast(event_id - 1 - user_id % 3 as varchar) else 'NA' end as parent_read_name,
  cast(event_id % 10 < 2 and event_id > 2 and user_id % 4 = 0 as int) as cross_tile, cast(floor(value * 100) % 5 <> 0 as boolean) as stays from events)"""
