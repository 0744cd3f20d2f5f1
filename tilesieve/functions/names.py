"""Read names, locations, signatures and quality sums as Columns (FN-1 to FN-10)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATION = r"^(.*):\s*([+-]?[0-9]+)\s*:\s*([+-]?[0-9]+)\s*:\s*([+-]?[0-9]+)\s*$"


def normalized_name(header: Column) -> Column:
    """First token of a header without its ``@`` and a trailing ``/1`` or ``/2``."""
    return F.regexp_replace(F.regexp_extract(header, r"^.\s*(\S+)", 1), "/[12]$", "")


def location(name: Column) -> dict[str, Column]:
    """``lane, tile, x, y``; all null unless the last three of four fields and more are integers.

    The lane key is what stands before them and may be empty.
    """
    found = name.rlike(LOCATION)

    def part(i: int) -> Column:
        return F.when(found, F.regexp_extract(name, LOCATION, i))

    return {"lane": part(1), "tile": part(2).try_cast("int"), "x": part(3).try_cast("int"), "y": part(4).try_cast("int")}


def tile_location(name: Column) -> Column:
    """The exact-match mode's location: lane key and tile together, null if unparsed."""
    at = location(name)
    return F.when(at["tile"].isNotNull(), F.concat_ws(":", at["lane"], at["tile"].cast("string")))


def pair_signature(r1: Column, r2: Column) -> Column:
    """SHA-256 of the first mate's length (four bytes, big-endian) and both mates."""
    return F.sha2(F.concat(F.unhex(F.lpad(F.hex(F.length(r1)), 8, "0")), F.encode(r1, "US-ASCII"), F.encode(r2, "US-ASCII")), 256)


def phred_sum(quals: Column, low: int | None = None, high: int | None = None) -> Column:
    """Sum of Phred+33 qualities, each within the given bounds.

    In Arrow batches: a loop over letters as a Column is interpreted, and takes the other
    columns of its projection out of compiled code.
    """

    def one(text: str | None) -> int | None:
        if text is None:
            return None
        q = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) - 33
        return int((q if low is None and high is None else np.clip(q, low, high)).sum())

    @F.pandas_udf("bigint")
    def total(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return total(quals)


def clipped_phred_sum(quals: Column) -> Column:
    return phred_sum(quals, 0, 60)


def base_letters(seq: Column) -> Column:
    """Upper-case ACGT; every other symbol is N, one for one."""
    return F.regexp_replace(F.translate(seq, "acgt", "ACGT"), "[^ACGT]", "N")


def seed_offsets(read_length: int, seed_length: int) -> list[int]:
    """0, L, 2L, ... and the last place a seed fits; none if the read is too short."""
    last = read_length - seed_length
    return sorted({*range(0, last + 1, seed_length), last}) if last >= 0 else []


def seed_entropy(seed: Column) -> Column:
    """Shannon entropy of the five symbols, in bits a base; 0 for an empty seed."""
    n = F.length(seed).cast("double")

    def term(letter: str) -> Column:
        share = (n - F.length(F.replace(seed, F.lit(letter), F.lit("")))) / n
        return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))

    return F.when(n > 0, sum((term(x) for x in "CGTN"), term("A"))).otherwise(F.lit(0.0))
