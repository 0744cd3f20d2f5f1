"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line of the corpus (by document id, then place) is
equal to it or within ``edits`` edits (one, or none for equal lines only): a
character inserted, deleted or replaced. ``min_chars``, 0 unless given, spares
shorter lines from edits. Lines without a visible character always stay.

Equal lines are one group from the start, counted with map-side combine, so a
line that a third of all documents share costs no more than any other. Of the
distinct lines of more than ``SHORT`` characters most have no partner, which their halves tell: one edit leaves
the first or the last ``c`` characters alone, ``c`` being the power of two that
both lengths share below half a line. Lines whose beginning or end occurs with
no other line of fitting length are out, and of the others, where they are longer
than a chunk, all windows of a chunk outside which no other line is the same. For each place in what is left that the
edit can be at, a line emits its variants: the line with that character deleted
and the line as it stands, each as a hash of what is before and what is behind
the place. Two lines within one edit share such a key, and any two lines that
share one are within one edit, so one minimum a key finds each line's earliest
partner and no pairs are formed. The partner is then verified by edit distance.

Hashes of beginnings and ends are chained over chunks, so a variant costs a chunk
and not the line, however long it is, and the rows of its windows carry the few chunks
that they need.

Texts are large beside what is learnt of them, so few are shuffled: only those of
documents with a line to compare, and in the end those of documents that lose a
line. Which these are, and which halves occur twice at all, a scan tells by a
broadcast bitmap of hashes (``marked``), 16 MB of bits at most: a bit that another
hash has set costs a row in a shuffle and changes nothing, since joins decide.

Edge cases: null texts count as empty, that is one line without visible
characters; rows with one id and one text are one document and get the same
result; rows with one id and different texts are different documents in an
arbitrary but fixed order; null ids come first; ties cannot arise between places;
an empty table gives no rows;
``dedup`` keeps other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilesieve.plans.shared import discard, materialize

MIN_CHARS = 0
SHORT = 8  # lines that emit variants whatever their halves
CHUNK = 64
BITS = 1 << 27  # of a bitmap, at most: 8 or more for each of up to 16 million hashes
AGGREGATE = 1 << 15  # bits of a result of bitmap_construct_agg
PIECE = 1 << 10  # bits of a row of the broadcast
VISIBLE = r"{} rlike '[^\\x20\\x09-\\x0D]'"


def marked(df: DataFrame, key: Column, hashes: DataFrame) -> DataFrame:
    """``df`` and ``may``: true wherever ``key`` is among the column ``h`` of ``hashes``, and
    for few other rows. ``hashes`` is materialized, for it is counted."""
    n, bits = hashes.count(), AGGREGATE
    while bits < min(8 * n, BITS):
        bits *= 2
    places = hashes.select(F.pmod("h", F.lit(bits)).alias("at")).select(F.expr(f"at div {AGGREGATE}").alias("bucket"), (F.col("at") % AGGREGATE).alias("bit"))
    maps = places.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    rows = AGGREGATE // PIECE
    pieces = maps.select("bucket", F.posexplode(F.expr(f"transform(sequence(0, {rows - 1}), i -> substring(map, i * {PIECE // 8} + 1, {PIECE // 8}))")).alias("no", "bitmap"))
    pieces = pieces.select((F.col("bucket") * rows + F.col("no")).alias("piece"), "bitmap")
    asked = df.withColumn("at", F.pmod(key, F.lit(bits))).withColumn("piece", F.expr(f"at div {PIECE}"))
    bit = f"cast(at % {PIECE} as int)"
    byte = f"cast(conv(hex(substring(bitmap, {bit} div 8 + 1, 1)), 16, 10) as int)"
    return asked.join(F.broadcast(pieces), "piece", "left").withColumn("may", F.expr(f"coalesce(shiftright({byte}, {bit} % 8) % 2 = 1, false)")).drop("at", "piece", "bitmap")


def _lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _half(n: Column) -> Column:
    """The largest power of two not above ``n / 2``."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n / 2))).cast("int")


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each distinct line with a visible character: its digests, its earliest
    place, its length and the hashes of its beginnings and ends."""
    lines = docs.select("id", "version", F.posexplode(_lines_of(F.col("text"))).alias("no", "line")).where(VISIBLE.format("line"))
    n = F.char_length("line")
    anchored = n >= max(SHORT, min_chars)
    c1, c2 = _half(n - 2), _half(n - 1)

    def hashes(c: Column) -> Column:
        return F.when(anchored, F.struct(c.alias("c"), F.xxhash64(F.substring("line", F.lit(1), c)).alias("first"), F.xxhash64(F.substring("line", n - c + 1, c)).alias("last")))

    keyed = lines.select(
        F.xxhash64("line").alias("k1"),
        F.xxhash64(F.lit(1), "line").alias("k2"),
        F.struct("id", "version", "no").alias("place"),
        n.alias("n"),
        hashes(c1).alias("a1"),
        F.when(c1 != c2, hashes(c2)).alias("a2"),
    )
    return keyed.groupBy("k1", "k2").agg(F.min("place").alias("place"), F.first("n").alias("n"), F.first("a1").alias("a1"), F.first("a2").alias("a2"))


def candidates(lines: DataFrame, min_chars: int) -> DataFrame:
    """``(k1, k2, place, from_start, c)``: lines that share a beginning or an end of ``c``
    characters with another line of the same length or one more or less, and all short ones."""
    ends = F.array(
        *(
            F.when(F.col(a).isNotNull(), F.struct(F.lit(start).alias("from_start"), F.col(f"{a}.c").alias("c"), F.col(f"{a}.{h}").alias("h")))
            for a in ("a1", "a2")
            for start, h in ((True, "first"), (False, "last"))
        )
    )
    each = lines.where("a1 is not null").select("k1", "k2", "place", "n", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("e")).select("k1", "k2", "place", "n", "e.*")
    half = F.xxhash64("from_start", "c", "h")
    twice = materialize(each.groupBy(half.alias("h")).agg(F.count("*").alias("k")).where("k > 1").select("h"), "halves")
    each = marked(each, half, twice).where("may").drop("may")
    key = ["from_start", "c", "h", "n"]
    counts = each.groupBy(*key).agg(F.count("*").alias("own"))
    near = counts.select("from_start", "c", "h", F.explode(F.array(F.struct((F.col("n") - 1).alias("n"), F.lit(0).cast("bigint").alias("own"), F.col("own").alias("all")), F.struct("n", "own", F.col("own").alias("all")), F.struct((F.col("n") + 1).alias("n"), F.lit(0).cast("bigint").alias("own"), F.col("own").alias("all")))).alias("x"))
    shared = near.select("from_start", "c", "h", "x.*").groupBy(*key).agg(F.sum("own").alias("own"), F.sum("all").alias("all")).where("own > 0 and all > 1").select(key)
    short = lines.where(F.col("n").between(min_chars, SHORT)).select("k1", "k2", "place", F.lit(True).alias("from_start"), F.lit(0).alias("c"))
    found = materialize(each.join(shared, key).select("k1", "k2", "place", "from_start", "c").union(short), "candidates")
    discard(twice)
    return found


def _with_chunks(lines: DataFrame) -> DataFrame:
    """Adds the chunks of each line and of its reverse, and the hashes of their whole first
    0, 1, 2, ... chunks."""
    out = lines.withColumn("back", F.reverse("line")).withColumn("n", F.char_length("line"))
    for text in ("line", "back"):
        parts = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        chain = F.aggregate(parts, F.array(F.lit(0).cast("bigint")), lambda done, x: F.concat(done, F.array(F.xxhash64(F.element_at(done, -1), x))))
        out = out.withColumn(f"{text}_parts", parts).withColumn(f"{text}_chain", chain)
    return out


def _first(text: str, count: str, shift: str = "0") -> str:
    """The hash of the first ``count`` characters, from the whole chunks before and a part;
    the arrays begin at chunk ``shift``."""
    at = f"cast(({count}) div {CHUNK} - {shift} as int)"
    return f"xxhash64(get({text}_chain, {at}), coalesce(left(get({text}_parts, {at}), cast(({count}) % {CHUNK} as int)), ''))"


def windows(survivors: DataFrame) -> DataFrame:
    """``(place, w)``: the chunk-wide windows of each line outside which another line of the
    same length, or one more or less, is the same; lines of one chunk have nothing outside.

    A line of n characters goes by its own length and by that of a line without the
    edit; either way what counts is all before the window and all behind it.
    """
    inside = f"if(from_start, sequence(c div {CHUNK}, n div {CHUNK}), sequence(0, (n - c) div {CHUNK}))"
    n = F.char_length("line")
    one = survivors.where(n <= CHUNK).select("place", F.explode(F.sequence(F.lit(0), F.floor(n / CHUNK).cast("int"))).alias("w"))
    by_length = ", ".join(f"struct({m} as m, {_first('back', f'greatest(0, {m} - (w + 1) * {CHUNK})')} as behind)" for m in ("n", "n - 1"))
    each = _with_chunks(survivors.where(n >= CHUNK)).select("place", F.explode(F.expr(f"transform({inside}, w -> struct(cast(w as int) as w, get(line_chain, cast(w as int)) as before, array({by_length}) as ends))")).alias("x"))
    each = each.select("place", "x.w", "x.before", F.explode("x.ends").alias("e")).select("place", "w", "e.m", "before", "e.behind").distinct()
    key = ["w", "m", "before", "behind"]
    shared = each.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").drop("k")
    return each.join(shared, key).select("place", "w").union(one).distinct()


def variants(survivors: DataFrame, wins: DataFrame) -> DataFrame:
    """``(key1, key2, place)`` for each place an edit can be at: the line without that
    character, and the line as it is."""
    lines = _with_chunks(survivors.select("place", "line").distinct())
    by_line = wins.groupBy("place").agg(F.collect_list("w").alias("ws"))
    # what a window's places can need of the line's end are three chunks from this one on
    low = f"greatest(0, n - (w + 1) * {CHUNK}) div {CHUNK}"
    part = f"struct(w, cast({low} as int) as low, get(line_chain, w) as chain, get(line_parts, w) as part, slice(back_chain, cast({low} as int) + 1, 3) as back_chain, slice(back_parts, cast({low} as int) + 1, 3) as back_parts)"
    each = lines.join(by_line, "place").select("place", "n", F.explode(F.expr(f"transform(ws, w -> {part})")).alias("x")).select("place", "n", "x.*")
    each = each.select("*", F.explode(F.expr(f"sequence(w * {CHUNK}, least(n, w * {CHUNK} + {CHUNK - 1}))")).alias("i"))
    before = f"xxhash64(chain, coalesce(left(part, i - w * {CHUNK}), ''))"
    without, whole = _first("back", "n - 1 - i", shift="low"), _first("back", "n - i", shift="low")
    each = each.select("place", "w", "i", F.expr(before).alias("before"), F.expr(f"array(if(i < n, {without}, null), {whole})").alias("behind"))
    each = each.select("place", "w", "i", "before", F.explode("behind").alias("behind")).where("behind is not null")
    return each.select(F.xxhash64("w", "i", "before", "behind").alias("key1"), F.hash("w", "i", "before", "behind").alias("key2"), "place")


def near_partners(docs: DataFrame, lines: DataFrame, min_chars: int) -> DataFrame:
    """``(k1, k2, partner)``: lines with an earlier line within one edit, and its place."""
    found = candidates(lines, min_chars)
    wanted = found.groupBy("place.id", "place.version").agg(F.collect_list(F.struct("k1", "k2", "place", "from_start", "c")).alias("wanted"))
    hashes = materialize(wanted.select(F.xxhash64("id", "version").alias("h")), "wanted")
    few = marked(docs, F.xxhash64("id", "version"), hashes).where("may")
    same = wanted.id.eqNullSafe(few.id) & (wanted.version == few.version)
    each = few.join(wanted, same).select(_lines_of(F.col("text")).alias("lines"), F.explode("wanted").alias("w"))
    survivors = materialize(each.select("w.*", F.expr("get(lines, w.place.no)").alias("line")).distinct(), "survivors")
    discard(found, hashes)
    keyed = variants(survivors, windows(survivors))
    partner = F.min("place").over(Window.partitionBy("key1", "key2"))
    hits = keyed.select("place", partner.alias("partner")).where("partner < place").groupBy("place").agg(F.min("partner").alias("partner"))
    text = survivors.select("k1", "k2", "place", "line").distinct()
    own = hits.join(text, "place")
    other = text.select(F.col("place").alias("partner"), F.col("line").alias("partner_line"))
    near = materialize(own.join(other, "partner").where(F.levenshtein("line", "partner_line", 1).between(0, 1)).select("k1", "k2", "partner"), "partners")
    discard(survivors)
    return near


def kept_lines(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """``(id, version, kept)`` for documents that lose a line: the places of the lines that
    stay, blank ones aside. Materialized."""
    lines = stay = materialize(distinct_lines(docs, min_chars), "lines")
    near = None
    if edits:
        near = near_partners(docs, lines, min_chars)
        stay = lines.join(near.select("k1", "k2"), ["k1", "k2"], "left_anti")
    split = docs.select("id", "version", _lines_of(F.col("text")).alias("lines"))
    visible = split.select("id", "version", F.expr(f"size(filter(lines, x -> {VISIBLE.format('x')}))").alias("visible"), F.lit(None).cast("int").alias("no"))
    both = visible.union(stay.select("place.id", "place.version", F.lit(None).cast("int"), "place.no"))
    by_document = both.groupBy("id", "version").agg(F.max("visible").alias("visible"), F.collect_list("no").alias("kept"))
    out = materialize(by_document.where("size(kept) < visible").select("id", "version", "kept"), "kept")
    discard(lines, near)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of the input as the struct ``row``, the number of lines, the number of
    lines dropped and the text without them."""
    if edits not in (0, 1):
        raise ValueError("the edit bound is 0 or 1: variants of more edits than one are not hashed")
    own = _documents(docs, id_col, text_col)
    kept = kept_lines(own, edits, min_chars)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    full = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("version"))
    full = marked(full, F.xxhash64("id", "version"), kept.select(F.xxhash64("id", "version").alias("h")))
    kept = kept.select(F.col("id").alias("kept_id"), F.col("version").alias("kept_version"), "kept")
    met = full.where("may")
    met = met.join(kept, met.id.eqNullSafe(F.col("kept_id")) & (met.version == F.col("kept_version")), "left").select("row", "kept")
    both = met.union(full.where("not may").select("row", F.lit(None).cast("array<int>")))
    lines = _lines_of(F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit("")))
    blank = F.expr(f"filter(sequence(0, size(lines) - 1), i -> not {VISIBLE.format('get(lines, i)')})")
    stay = F.when(F.col("kept").isNull(), F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.array_sort(F.concat("kept", blank)))
    out = both.withColumn("lines", lines).withColumn("stay", stay)
    return out.select(
        "row",
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("bigint").alias("n_dropped"),
        F.concat_ws("\n", F.expr("transform(stay, i -> get(lines, i))")).alias("text"),
    )
