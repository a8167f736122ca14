"""Token arrays of sequences: encoding, cropping, chunks, masks, stimuli; and clean-up of generated text."""

from __future__ import annotations

from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtrend.functions.rand import rand_key

# The letters in the order of their ids, and the special tokens that follow them.
LETTERS = "ACDEFGHIKLMNPQRSTVWYBXJZUO"
CLS, SEP, MASK = 26, 27, 28
#: Tiles of a sequence that a test has many times over.
STEPS = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def made_once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """``df`` with a costly column that a filter behind it doesn't make again.

    Filters move below a projection together with what they test, but not below the rows of an array.
    """
    return df.select("*", F.explode_outer(F.array(column)).alias(name))


def _letters(seq: Column) -> Column:
    return F.when(seq == "", F.array().cast("array<string>")).otherwise(F.split(seq, ""))


def letter_ids(seq: Column | str, start: Column | None = None, length: int | None = None) -> Column:
    """Ids of the letters; ``*`` is SEP, an unknown letter an error. With ``length`` only of that many behind ``start``,
    though all are looked at for unknown ones."""

    def ids(s: Column) -> Column:
        # What is unknown is looked for in the text, not letter by letter; SEP is one behind CLS.
        unknown = F.raise_error(F.concat(F.lit("no letter: "), F.left(F.translate(s, LETTERS + "*", ""), F.lit(1)))).cast("array<int>")
        one = lambda c: F.instr(F.lit(f"{LETTERS}\0*"), c) - 1
        held = s if length is None else F.substring(s, F.lit(1) if start is None else start + 1, F.lit(length))
        return F.when(s.rlike(f"[^{LETTERS}*]"), unknown).otherwise(F.transform(_letters(held), one))

    # An array of one: the text is made once.
    return F.element_at(F.transform(F.array(_col(seq)), ids), 1)


def encode(seq: Column | str, longest: int | None = None) -> Column:
    """[CLS] and the letters' ids, ``longest`` in all at most; a sequence that does not end in ``*`` is an error."""
    ends = F.when(_col(seq).endswith("*"), F.array(F.lit(CLS))).otherwise(F.raise_error(F.lit("no end mark")).cast("array<int>"))
    return F.concat(ends, letter_ids(seq, length=None if longest is None else longest - 1))


def pad_or_crop(seq: Column | str, max_len: int, key: Column, ignore_too_long: bool = False) -> Column:
    """struct<input_ids,attention_mask,labels>: [CLS] and at most max_len - 1 letters, zero-padded.

    A longer sequence is cropped at a place drawn by ``key`` (or null with ``ignore_too_long``); labels are
    -100 where the mask is 0.
    """
    size, room = F.length(_col(seq)), max_len - 1
    start = F.when(size > room, F.pmod(key, (size - room + 1).cast("long")).cast("int")).otherwise(0)
    held = F.concat(F.array(F.lit(CLS)), letter_ids(seq, start, room))
    blank = lambda v, n: F.array_repeat(F.lit(v), F.greatest(n, F.lit(0)))
    rest = F.lit(max_len) - F.size(held)
    out = F.struct(F.concat(held, blank(0, rest)).alias("input_ids"), F.concat(blank(1, F.size(held)), blank(0, rest)).alias("attention_mask"), F.concat(held, blank(-100, rest)).alias("labels"))
    return F.when((size <= room) | F.lit(not ignore_too_long), out)


def pool_form(ids: Column | str, max_len: int, split_token: Column | None = None) -> Column:
    """struct<input_ids,attention_mask>: truncated or padded; null without an end token; the mask runs up to it.

    A ``split_token`` goes to the second place, in the room of max_len.
    """

    def fill(ids: Column) -> Column:
        if split_token is None:
            held = F.slice(ids, 1, max_len)
        else:
            held = F.concat(F.slice(ids, 1, 1), F.array(split_token), F.slice(ids, 2, max_len))
        return F.slice(F.concat(held, F.array_repeat(F.lit(0), max_len)), 1, max_len)

    def masked(held: Column) -> Column:
        end = F.array_position(held, F.lit(SEP)).cast("int")
        mask = F.concat(F.array_repeat(F.lit(1), end), F.array_repeat(F.lit(0), F.lit(max_len) - end))
        return F.when(end > 0, F.struct(held.alias("input_ids"), mask.alias("attention_mask")))

    # Arrays of one: the ids are made once.
    return F.element_at(F.transform(F.transform(F.array(_col(ids)), fill), masked), 1)


def chunk_sequence(df: DataFrame, max_len: int, seq: str = "seq") -> DataFrame:
    """One row per piece of max_len letters (column piece, numbered by fragment), without one trailing ``*``."""
    bare = F.when(F.col(seq).endswith("*"), F.left(F.col(seq), F.length(seq) - 1)).otherwise(F.col(seq))
    # One pass over the text: a piece cut out by its place is looked for from the begin of the text.
    pieces = F.regexp_extract_all(bare, F.lit(f"(?s).{{1,{max_len}}}"), F.lit(0))
    return df.select("*", F.posexplode_outer(pieces).alias("fragment", "piece")).where("piece is not null")


def anchor_length(seq: Column | str, suffix: bool = False, longest: int = 21) -> Column:
    """Length of the shortest prefix (suffix) that occurs nowhere else in the sequence; null if none up to ``longest``."""
    s = _col(seq)

    def shortest(text: Column) -> Column:
        unique = lambda n: (n <= F.length(text)) & (F.position(F.substring(text, F.lit(1), n), text, F.lit(2)) == 0)
        # No text is looked through again once a length is found.
        return F.aggregate(F.sequence(F.lit(1), F.lit(longest)), F.lit(0), lambda at, n: F.when((at == 0) & unique(n), n).otherwise(at), lambda at: F.when(at > 0, at))

    # An array of one: the text is made once.
    return F.element_at(F.transform(F.array(F.reverse(s) if suffix else s), shortest), 1)


def mask_at(seq: Column | str, start: Column, length: Column) -> Column:
    """struct<encoder,decoder> of token arrays: [CLS] left [MASK] right [SEP], and span [MASK]."""
    s = _col(seq)
    left, span = _letters(F.substring(s, F.lit(1), start)), _letters(F.substring(s, start + 1, length))
    right = _letters(F.substring(s, start + length + 1, F.length(s)))
    one = lambda t: F.array(F.lit(t))
    return F.struct(F.concat(one("[CLS]"), left, one("[MASK]"), right, one("[SEP]")).alias("encoder"), F.concat(span, one("[MASK]")).alias("decoder"))


def masked_places(df: DataFrame, seed: int, shortest: int = 1, longest: int = 50, least_unmasked: int = 2, include_ends: bool = False, seq: str = "seq") -> DataFrame:
    """``df`` with mask_start and mask_length; rows for which no mask is possible are dropped."""
    s = F.col(seq)
    left, right = (F.lit(0), F.lit(0)) if include_ends else (anchor_length(s), anchor_length(s, suffix=True))
    rows = made_once(df, F.struct(left.alias("l"), right.alias("r")), "_ends").withColumns({"_left": F.col("_ends.l"), "_right": F.col("_ends.r")}).where("_ends.l is not null and _ends.r is not null")
    most = F.least(F.floor(F.length(s) / 2), F.lit(longest), F.length(s) - least_unmasked, F.length(s) - F.col("_left") - F.col("_right")).cast("int")
    rows = rows.withColumn("_most", most).where(F.col("_most") >= shortest)
    rows = made_once(rows, (F.lit(shortest) + F.pmod(rand_key(seed, s), (F.col("_most") - shortest + 1).cast("long"))).cast("int"), "mask_length")
    room = F.length(s) - F.col("mask_length") - F.col("_right") - F.col("_left") + 1
    rows = rows.withColumn("_room", room).where("_room > 0")
    rows = rows.withColumn("mask_start", (F.col("_left") + F.pmod(rand_key(seed + 1, s), F.col("_room").cast("long"))).cast("int"))
    return rows.drop("_ends", "_left", "_right", "_most", "_room")


def masked_example(df: DataFrame, seed: int, seq: str = "seq", **places) -> DataFrame:
    """``df`` with mask_start, mask_length and example, as ``masked_places`` finds them."""
    return masked_places(df, seed, seq=seq, **places).withColumn("example", mask_at(seq, F.col("mask_start"), F.col("mask_length")))


TILES = "array<struct<mask_start:int,mask_length:int>>"


def tiles(seq: Column | str, seed: int | str, shortest: int, longest: int) -> Column:
    """array<struct<mask_start,mask_length>>: consecutive masks of random length over the sequence, the last may
    reach beyond it; never two of length 0 in a row.

    Draws are keyed by seed, sequence and number, as ``rand_key`` makes them. A fold in Spark copies all tiles found
    so far with every step, so a long sequence takes time with the square; only its length and key go to this function.
    """
    if longest < max(shortest, 1):
        raise ValueError("the longest mask is too short")

    @F.arrow_udf(TILES)
    def drawn(n: pa.Array, key: pa.Array) -> pa.Array:
        starts, lengths, ends = array("i"), array("i"), [0]
        for size, k in zip(n.to_pylist(), key.to_pylist()):
            at, last, i = 0, -1, 0
            while size is not None and at < size:
                i += 1
                low = max(shortest, 1) if last == 0 else shortest
                last = low + int(sha256(f"{seed}|{k}|{i}".encode()).hexdigest()[:15], 16) % (longest - low + 1)
                starts.append(at)
                lengths.append(last)
                at += last
            ends.append(len(starts))
        found = pa.StructArray.from_arrays([pa.array(np.array(x, "int32")) for x in (starts, lengths)], ["mask_start", "mask_length"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    s = _col(seq)
    return drawn(F.length(s), rand_key(seed, s))


def tile_masks(df: DataFrame, seed: int | str, shortest: int = 0, longest: int = 128, seq: str = "seq", spans: str | None = None, least_extra: int = 0) -> DataFrame:
    """``df`` with one row per tile (mask_start, mask_length) of the sequence.

    With ``spans`` (array<struct<start,end>>) only the tiles that hold a changed place are kept, and as many
    more of all tiles at random, ``least_extra`` at least, each at most once. Draws depend on seed and sequence
    alone. A null or empty sequence has no tiles, null spans are none.
    """
    rows = made_once(df, tiles(seq, seed, shortest, longest), "_every")
    chosen = F.col("_every")
    if spans is not None:
        touched = lambda t: F.exists(spans, lambda c: (c["start"] < t["mask_start"] + t["mask_length"]) & (c["end"] > t["mask_start"]) & (c["end"] > c["start"]))
        rows = rows.withColumn("_hit", F.filter("_every", lambda t: (t["mask_length"] > 0) & F.coalesce(touched(t), F.lit(False))))
        rows = rows.withColumn("_key", rand_key(seed, seq))
        drawn = F.array_sort(F.transform("_every", lambda t, i: F.struct(rand_key(f"{seed}-extra", F.col("_key"), i).alias("k"), i.alias("i"), t.alias("t"))))
        extra = F.transform(F.slice(drawn, F.lit(1), F.greatest(F.lit(least_extra), F.size("_hit"))), lambda x: x["t"])
        chosen = F.concat("_hit", extra)
    rows = rows.withColumn("_tile", F.explode_outer(chosen)).where("_tile is not null").select("*", "_tile.*")
    return rows.drop("_every", "_hit", "_key", "_tile")


def sliding_stimuli(df: DataFrame, window: int = 64, step: int = 32, frozen: list[int] | None = None, seq: str = "seq") -> DataFrame:
    """One row per window every ``step`` letters, before the last letter, cut at frozen places: mask_start, mask_length."""
    size = F.length(seq)
    ice = F.array(*map(F.lit, sorted(frozen or []))).cast("array<int>")
    starts = F.transform(F.sequence(F.lit(0), size - 1, F.lit(step)), lambda s: F.struct(s.alias("a"), F.least(s + window, size - 1).alias("b")))
    rows = df.where(size > 0).select("*", F.explode(starts).alias("_w")).where("_w.b > _w.a")
    inside = F.filter(ice, lambda f: (f >= F.col("_w.a")) & (f < F.col("_w.b")))
    cuts = F.concat(F.array(F.col("_w.a") - 1), inside, F.array(F.col("_w.b")))
    parts = F.zip_with(F.slice(cuts, F.lit(1), F.size(cuts) - 1), F.slice(cuts, F.lit(2), F.size(cuts) - 1), lambda x, y: F.struct((x + 1).alias("mask_start"), (y - x - 1).alias("mask_length")))
    rows = rows.select("*", F.explode(F.filter(parts, lambda p: p["mask_length"] > 0)).alias("_p")).select("*", "_p.*")
    return rows.drop("_w", "_p")


def clean_generated(text: Column | str, style: str = "end") -> Column:
    """Generated text as a sequence. end: cut behind the first ``*``; marker: without <|endoftext|>, trailing ``*`` as one;
    framed: ``1...2`` as ``...*``."""
    t = _col(text)
    if style == "end":
        return F.when(F.instr(t, "*") > 0, F.substring(t, F.lit(1), F.instr(t, "*"))).otherwise(t)
    if style == "marker":
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"<\|endoftext\|>", ""), r"\s+", ""), r"\*+$", "*")
    if style == "framed":
        return F.when(t.rlike("^1[^12]*2"), F.concat(F.regexp_extract(t, "^1([^12]*)2", 1), F.lit("*")))
    raise ValueError(f"no style {style!r}")


def pad_leading_weeks(counts: Column | str, n: int) -> Column:
    """The first n counts, zero-padded."""
    c = _col(counts)
    return F.slice(F.concat(c, F.array_repeat(F.lit(0).cast("double"), n)), 1, n)


def discretise(p: Column | str, ranges: list[tuple[float, float]]) -> Column:
    """Index of the last range with lo <= p < hi; 0 if there is none."""
    out = F.lit(0)
    for i, (low, high) in enumerate(ranges):
        out = F.when((_col(p) >= F.lit(float(low))) & (_col(p) < F.lit(float(high))), F.lit(i)).otherwise(out)
    return out
