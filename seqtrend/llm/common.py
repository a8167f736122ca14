"""What the corpus operators share: scratch tables, size-checked joins, native spans, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqtrend.sources.scratch import scratch_path, stored

__all__ = ["connected_components", "join_counted", "keyed_anti", "let", "match_spans", "row_key", "scratch_path", "small", "stored"]

#: A side of a join is broadcast only if it was counted and has no more rows than this (narrow rows).
BROADCAST_ROWS = 1_000_000
#: Edges that one task contracts; more of them are shuffled.
TASK_EDGES = 200_000
#: A key with more rows than this is hot: its row of the other side is broadcast, not the key's rows dealt to one task.
HOT_ROWS = 2_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it was counted as small; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Inner join of ``rows`` with a table of one row per key, whose column ``n`` says how many rows the key has.

    Hot keys, of which there are at most a HOT_ROWS-th of the rows, are joined by a broadcast (if counted as few),
    the others by a shuffle. Keys must not be null.
    """
    hot = table.where(F.col(n) > HOT_ROWS)
    cold = table.where(F.col(n) <= HOT_ROWS)
    if hot.isEmpty():
        return rows.join(cold, keys)
    return rows.join(small(hot), keys).unionByName(rows.join(small(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def row_key() -> Column:
    """Identifies a document's row by id and text, also where the id is null or repeated."""
    return F.xxhash64("doc_id", "text")


def keyed_anti(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, row key) is not in ``keys`` (columns doc_id, _k); same columns as before."""
    keys = small(keys.select(F.col("doc_id").alias("_llm_id"), F.col("_k").alias("_llm_k")).distinct())
    return docs.join(keys, (row_key() == keys["_llm_k"]) & docs["doc_id"].eqNullSafe(keys["_llm_id"]), "left_anti")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where the body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of all non-overlapping matches, in code points, end exclusive.

    ``split`` gives what stands between the matches and ``regexp_extract_all`` the matches, so running
    sums of their lengths are positions. Sums are taken in two levels of 256, so long arrays stay cheap.
    """
    block = 256
    add = lambda a, x: a + x

    def from_parts(p: Column) -> Column:
        lens = F.zip_with(p["gaps"], p["hits"], lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))

        def from_lens(lens: Column) -> Column:
            blocks = F.transform(
                F.sequence(F.lit(0), F.floor(F.size(lens) / block).cast("int")),
                lambda b: F.aggregate(F.slice(lens, b * block + 1, block), F.lit(0), add),
            )

            def place(blocks: Column) -> Column:
                offsets = F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), add))

                def one(offsets: Column) -> Column:
                    def span(hit: Column, i: Column) -> Column:
                        b = F.floor(i / block).cast("int")
                        before = offsets[b] + F.aggregate(F.slice(lens, b * block + 1, i - b * block), F.lit(0), add)
                        whole = lambda start: F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"))
                        return let(before + F.length(p["gaps"][i]), whole)

                    return F.transform(p["hits"], span)

                return let(offsets, one)

            return let(blocks, place)

        return let(lens, from_lens)

    parts = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits")
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(parts, from_parts)).otherwise(none)


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of ``edges`` (a, b); component is some vertex of the same component.

    Randomised contraction: each round maps every vertex to the smallest of its closed neighbourhood in a
    hashed order and contracts the edges. The edges shrink geometrically; no group is ever gathered.
    """
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while rows := edges.count():
        # Few edges need few tasks: a table that was counted as small isn't dealt over all shuffle partitions.
        dealt = (lambda df: df.coalesce(1)) if rows <= TASK_EDGES else (lambda df: df)
        edges, seed = dealt(edges), F.lit(len(maps))
        rank = lambda c: F.struct(F.xxhash64(seed, c).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
        both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
        step = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", rank("a"))["v"].alias("to"))
        maps.append(step := dealt(stored(step, "contraction")))
        to_a, to_b = step.toDF("a", "ta"), step.toDF("b", "tb")
        moved = edges.join(to_a, "a").join(to_b, "b").where("ta <> tb")
        edges = stored(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    labels = maps[-1].toDF("v", "component")
    for step in reversed(maps[:-1]):
        later = labels.toDF("to", "component")
        labels = step.join(later, "to", "left").select("v", F.coalesce("component", "to").alias("component"))
    return labels
