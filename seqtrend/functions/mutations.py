"""Mutation strings, sequences and their comparison.

A mutation is ``<ref><pos><alt>``; ``ins<pos><letters>`` inserts after pos (0: at the front; deviation from
the usual last-place slip), ``<ref><pos>del`` deletes, ``<ref><pos>stop`` ends. A variant's key is its
mutations by position, joined with commas; ``""`` is the reference and a key like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One mutation, the ambiguity letters.
MUTATION = r"[A-Za-z]+\d+[A-Za-z]+"
AMBIGUOUS = {"B": "DN", "J": "IL", "Z": "EQ"}
SPANS = "array<struct<start:int,end:int>>"


def extract_mutations(aa: Column | str, protein: str = "Spike") -> Column:
    """All ``<protein>_<mutation>`` of the text, by position (ties as they stand), joined with commas; none: ``""``."""
    text = F.coalesce(F.col(aa) if isinstance(aa, str) else aa, F.lit(""))
    found = F.regexp_extract_all(text, F.lit(f"{protein}_({MUTATION})"), F.lit(1))
    keyed = F.transform(found, lambda m, i: F.struct(F.regexp_extract(m, r"\d+", 0).cast("int").alias("pos"), i.alias("i"), m.alias("m")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["m"]), ",")


def canonical_mutations(aa: Column | str) -> Column:
    """The list without outer parentheses, trimmed, by protein and position; what can't be parsed comes first."""
    text = F.regexp_replace(F.trim(F.coalesce(F.col(aa) if isinstance(aa, str) else aa, F.lit(""))), r"^\(|\)$", "")
    shape = r"^([^_]+)_[A-Za-z]+(\d+)[A-Za-z]+$"
    key = lambda m, i: F.struct(
        F.regexp_extract(m, shape, 1).alias("protein"), F.when(m.rlike(shape), F.regexp_extract(m, shape, 2).cast("int")).otherwise(0).alias("pos"), i.alias("i"), m.alias("m")
    )
    return F.array_join(F.transform(F.array_sort(F.transform(F.transform(F.split(text, ","), lambda t: F.trim(t)), key)), lambda s: s["m"]), ",")


def tokens(m: Column | str) -> Column:
    """The mutations of a key; none for ``""``."""
    return F.filter(F.split(F.col(m) if isinstance(m, str) else m, ","), lambda t: t != "")


def position(token: Column) -> Column:
    return F.regexp_extract(token, r"\d+", 0).cast("int")


def mutation_units(m: Column | str) -> Column:
    """The mutations of a key, runs of deletions at consecutive positions being one unit."""
    step = lambda acc, t: F.when(
        t.endswith("del") & (F.size(acc) > 0) & F.coalesce(F.element_at(acc, -1).endswith("del") & (position(F.element_at(F.split(F.element_at(acc, -1), ","), -1)) + 1 == position(t)), F.lit(False)),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(","), t))),
    ).otherwise(F.concat(acc, F.array(t)))
    return F.aggregate(tokens(m), F.array().cast("array<string>"), step)


def is_valid_sample(seq: Column | str) -> Column:
    """No bracketed special token, and exactly one end mark ``*``."""
    s = F.col(seq) if isinstance(seq, str) else seq
    return F.coalesce(~s.rlike(r"[\[\]<>]") & (F.length(s) - F.length(F.replace(s, F.lit("*"), F.lit(""))) == 1), F.lit(False))


def _ambiguous(a: Column, b: Column) -> Column:
    """Letter a stands for b."""
    out = F.lit(False)
    for letter, means in AMBIGUOUS.items():
        out = out | ((a == letter) & b.isin(*means))
    return out


def _everywhere(a: Column, b: Column, same, odd: Column) -> Column:
    """Without ambiguity letters only equal texts agree: place by place are compared only those that hold some."""
    placed = F.forall(F.zip_with(F.split(a, ""), F.split(b, ""), same), lambda x: x)
    return F.when(a == b, True).when(F.length(a) != F.length(b), False).when(~odd, False).otherwise(placed)


def verify_sequence(sequenced: Column | str, imputed: Column | str) -> Column:
    """Same length and per place: equal, or sequenced is X, or an ambiguity letter that covers the imputed one."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (sequenced, imputed))
    return _everywhere(a, b, lambda x, y: (x == y) | (x == "X") | _ambiguous(x, y), a.rlike("[BXJZ]"))


def compatible(a: Column | str, b: Column | str) -> Column:
    """Same length and per place: equal, or either is X, or an ambiguity letter covers the other."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return _everywhere(a, b, lambda x, y: (x == y) | (x == "X") | (y == "X") | _ambiguous(x, y) | _ambiguous(y, x), a.rlike("[BXJZ]") | b.rlike("[BXJZ]"))


# -- helpers on one value, run in Arrow batches over distinct keys ---------------------------------------


def parse(m: str) -> list[tuple[str, int, str]]:
    out = []
    for token in filter(None, m.split(",")):
        found = re.fullmatch(r"([A-Za-z]+)(\d+)([A-Za-z]+)", token)
        if not found:
            raise ValueError(f"not a mutation: {token!r}")
        out.append((found[1], int(found[2]), found[3]))
    return out


def mutated(m: str, reference: str) -> str:
    """The reference with the mutations of a key."""
    letters, after = list(reference), {}
    for ref, pos, alt in parse(m):
        if not (0 if ref == "ins" else 1) <= pos <= len(reference):
            raise ValueError(f"no position {pos} in a reference of {len(reference)}")
        if ref == "ins":
            after[pos] = after.get(pos, "") + alt
        else:
            letters[pos - 1] = "" if alt == "del" else alt
    return after.get(0, "") + "".join(x + after.get(i, "") for i, x in enumerate(letters, 1))


def spans(m: str) -> list[tuple[int, int]]:
    """(start, end) of each change in the mutated sequence; consecutive deletions make one span of width 2."""
    out, shift, gap = [], 0, None
    for ref, pos, alt in parse(m):
        if ref == "ins":
            out.append((pos + shift - 1, pos + shift + len(alt) + 1))
            shift += len(alt)
            gap = None
        elif alt == "del":
            shift -= 1
            if gap != pos - 1:
                out.append((pos + shift - 1, pos + shift + 1))
            gap = pos
        else:
            out.append((pos + shift - 1, pos + shift - 1 + len(alt)))
            shift += len(alt) - 1
            gap = None
    return [(max(0, a), b) for a, b in out]


# Scores of an alignment, in tenths so that sums are exact.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND = 10, -10, -40, -1
#: Score of what can't be, and cells whose steps are held at once.
NEVER, CELLS = -(10**12), 1 << 24


def _rows(a: np.ndarray, b: np.ndarray, m: int, band: int, state: np.ndarray, first: int, steps: np.ndarray | None = None) -> np.ndarray:
    """Scores (pair, gap in seq, gap in ref; place in the band) of the row behind the last letter of ``a``.

    ``state`` has those of row ``first``, ``b`` the letters padded by the band. Place t of row i is column
    i - band + t. ``steps`` takes, per cell, where each of the three came from, two bits each.
    """
    width = 2 * band + 1
    along = GAP_EXTEND * np.arange(width)
    for r, letter in enumerate(a):
        i = first + r + 1
        pair, down, right = state
        best = np.maximum(np.maximum(pair, down), right)
        now = np.full((3, width), NEVER)
        now[0] = best + np.where(b[i : i + width] == letter, MATCH, MISMATCH)
        opened = np.maximum(pair, right)[1:] + GAP_OPEN
        now[1, :-1] = np.maximum(opened, down[1:] + GAP_EXTEND)
        low, high = max(0, band - i), min(width, m - i + band + 1)  # columns 0 to m
        now[0, : max(0, band - i + 1)] = NEVER
        now[:2, :low] = now[:2, high:] = NEVER
        # A gap in the reference runs along the row: the best place to open it is a running maximum.
        base = np.maximum(now[0], now[1])
        now[2, 1:] = np.maximum.accumulate(base - along)[:-1] + along[:-1] + GAP_OPEN
        now[2, :low] = now[2, high:] = NEVER
        if steps is not None:
            steps[r] = np.where(pair == best, 0, np.where(down == best, 1, 2))
            up = np.maximum(opened, down[1:] + GAP_EXTEND)
            steps[r, :-1] |= np.where(pair[1:] + GAP_OPEN == up, 0, np.where(down[1:] + GAP_EXTEND == up, 4, 8)).astype(np.uint8)
            steps[r, 1:] |= np.where(now[0, :-1] + GAP_OPEN == now[2, 1:], 0, np.where(now[1, :-1] + GAP_OPEN == now[2, 1:], 16, 32)).astype(np.uint8)
        state = now
    return state


def _gotoh(ref: str, seq: str, band: int) -> tuple[int, str]:
    """Score in tenths and steps (M, D, I) of a best global alignment inside a band, with affine gaps.

    Rows are scored one after another and only every so many are kept; from the last on, the steps of a stretch
    between two of them are found again when the path gets there. So memory is in proportion to the root of
    the band's cells, not to them, and a row is scored twice.
    """
    n, m, width = len(ref), len(seq), 2 * band + 1
    a, b = (np.frombuffer(x.encode("utf-32-le"), "<u4").astype(np.int64) for x in (ref, seq))
    b = np.concatenate([np.full(band + 1, -1), b, np.full(max(0, n + width - m), -1)])
    state = np.full((3, width), NEVER)
    state[0, band] = 0
    state[2, band + 1 : band + 1 + m] = GAP_OPEN + GAP_EXTEND * np.arange(min(band, m))
    stretch = max(1, n if n * width <= CELLS else min(n, int(np.sqrt(24 * n)), max(1, CELLS // width)))
    kept = [state]
    for at in range(0, n, stretch):
        if at + stretch < n:
            kept.append(_rows(a[at : at + stretch], b, m, band, kept[-1], at))
    path, i, j, kind, total = [], n, m, None, 0
    for k in range(len(kept) - 1, -1, -1):
        begin = k * stretch
        steps = np.zeros((min(stretch, n - begin), width), np.uint8)
        last = _rows(a[begin : begin + stretch], b, m, band, kept[k], begin, steps)
        if kind is None:
            end = last[:, m - n + band]
            kind = int(end.argmax())
            total = int(end[kind])
        while i > begin:
            came = int(steps[i - begin - 1, j - i + band]) >> 2 * kind & 3
            path.append("MDI"[kind])
            i, j, kind = i - (kind != 2), j - (kind != 1), came
        kept.pop()
    path.append("I" * j)
    return total, "".join(reversed(path))


def global_alignment(ref: str, seq: str) -> tuple[float, str]:
    """Score and steps of a best global alignment.

    Equal ends are paired first, which loses no score where a match counts more than a gap. The middle is
    aligned in a band that doubles until no path that leaves it could score as much.
    """
    n, m = len(ref), len(seq)
    tail = 0
    while tail < min(n, m) and ref[n - 1 - tail] == seq[m - 1 - tail]:
        tail += 1
    head = 0
    while head < min(n, m) - tail and ref[head] == seq[head]:
        head += 1
    a, b = ref[head : n - tail], seq[head : m - tail]
    apart = abs(len(a) - len(b))
    band = apart + 16
    while True:
        score, steps = _gotoh(a, b, band)
        # Beyond the band a path has gaps of over (band + difference) / 2 letters one way, and so fewer pairs.
        gaps = (band + apart) // 2
        if band >= max(len(a), len(b)) or score >= MATCH * max(0, min(len(a), len(b)) - gaps) + 2 * GAP_OPEN:
            break
        band *= 2
    return (score + MATCH * (head + tail)) / 10, "M" * head + steps + "M" * tail


def aligned(ref: str, seq: str, merge_insertions: bool = True) -> str:
    """The mutations that turn ``ref`` into ``seq``, by a global alignment."""
    if ref == seq:
        return ""
    out, i, j = [], 0, 0
    for step in global_alignment(ref, seq)[1]:
        if step == "M":
            if ref[i] != seq[j]:
                out.append(f"{ref[i]}{i + 1}{seq[j]}")
            i, j = i + 1, j + 1
        elif step == "D":
            out.append(f"{ref[i]}{i + 1}del")
            i += 1
        else:
            if merge_insertions and out and re.fullmatch(rf"ins{i}[A-Za-z]+", out[-1]):
                out[-1] += seq[j]
            else:
                out.append(f"ins{i}{seq[j]}")
            j += 1
    return ",".join(out)


def units_of(m: str) -> list[str]:
    out: list[str] = []
    for token in filter(None, m.split(",")):
        if out and token.endswith("del") and out[-1].endswith("del") and int(re.search(r"\d+", out[-1].split(",")[-1])[0]) + 1 == int(re.search(r"\d+", token)[0]):
            out[-1] += "," + token
        else:
            out.append(token)
    return out


def unit_distance(m0: str, m1: str) -> int:
    """Insertions and deletions of units that turn one into the other: both lengths less twice the longest common subsequence."""
    a, b = units_of(m0), units_of(m1)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        equal = np.array([x == y for y in b], bool)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(equal, row[:-1] + 1, 0))) if len(b) else row[1:]
    return len(a) + len(b) - 2 * int(row[-1])


def _mapped(df: DataFrame, keys: list[str], out: str, kind: str, f) -> DataFrame:
    """``df`` with ``out`` = f(keys), computed once per distinct key.

    The function counts as non-deterministic, so the optimizer neither infers filters from it nor moves it
    below the distinct, where it would run on every row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if any(v is None for v in values) else f(*values) for values in batch.itertuples(index=False)], dtype=object)

    udf = F.pandas_udf(run, kind).asNondeterministic()
    # Keys are few bytes but cost much: adaptive plans would join the parts of the distinct to one task. They are dealt
    # to a number of parts by a hash of their own, for by the keys themselves they would stay as they are.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = df.select(*keys).distinct().repartition(parts, F.xxhash64(*keys)).withColumn(out, udf(F.struct(*keys)))
    return df.join(table, keys, "left")


def apply_mutations(df: DataFrame, reference: str, m: str = "m", out: str = "seq") -> DataFrame:
    """``df`` with the full sequence of the key in ``m``; a bad token or position is an error."""
    return _mapped(df, [m], out, "string", lambda x: mutated(x, reference))


def changed_spans(df: DataFrame, m: str = "m", out: str = "spans") -> DataFrame:
    return _mapped(df, [m], out, SPANS, lambda x: [{"start": a, "end": b} for a, b in spans(x)])


def align_mutations(df: DataFrame, reference: str, seq: str = "seq", out: str = "m", merge_insertions: bool = True) -> DataFrame:
    """``df`` with the mutations from ``reference`` to the sequence."""
    return _mapped(df, [seq], out, "string", lambda x: aligned(reference, x, merge_insertions))


def edit_distance(df: DataFrame, m0: str, m1: str, out: str = "distance", insert_only: bool = False) -> DataFrame:
    """Distance in units; ``insert_only``: units added to m0 to get m1, null (infinite) if m0 is no subsequence."""
    if not insert_only:
        return _mapped(df, [m0, m1], out, "int", unit_distance)
    a, b = mutation_units(m0), mutation_units(m1)
    # Greedy subsequence test: each unit of m0 is looked for behind the last hit.
    hit = F.aggregate(a, F.lit(0), lambda at, u: F.when(at < 0, at).otherwise(F.coalesce(F.get(F.filter(F.transform(b, lambda x, i: F.when((x == u) & (i >= at), i + 1)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1))))
    return df.withColumn(out, F.when(hit >= 0, F.size(b) - F.size(a)))
