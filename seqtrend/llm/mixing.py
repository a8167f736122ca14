"""Mixing sources to target weights by iterative proportional fitting (raking).

Token totals are taken per cell (source, language, topic); the cells' weights are raked until their sums meet
the target share of every source, language and topic. Documents are then drawn by the calibrated probability
of their cell, with a hash of the row as the random number, so a repeated task draws the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtrend.llm.common import small, stored

DIMENSIONS = ("source", "lang", "topic")
#: Targets: the share of each value to this power. 1 keeps a marginal, 0 evens it out.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 1.0}
#: Share of all tokens to draw; 1 stands for as many as the targets allow, and for LEAST_SHARE where rare cells allow less.
KEEP_SHARE, LEAST_SHARE = 1.0, 0.5
TOLERANCE, SWEEPS = 1e-6, 40
TASK_CELLS = 100_000


def n_tokens() -> Column:
    """Words of a text: runs of other than white space; 0 for null."""
    return F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long")


def topic() -> Column:
    """What kind of text it is, from the marks it holds: a table, code or markup, a notice, or prose."""
    t = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(t.contains(" | "), "table")
        .when(t.contains("{") | t.contains("</"), "markup")
        .when(t.contains("Licensed") | t.contains("Copyright") | t.contains("©"), "notice")
        .otherwise("prose")
    )


def cells(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens, docs); null values are a value of their own, the empty string."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in DIMENSIONS[:2]], topic().alias("topic"), n_tokens().alias("n"))
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))


def targets(table: DataFrame, powers: dict[str, float] = POWERS, shares: dict[str, dict[str, float]] | None = None) -> dict[str, DataFrame]:
    """Per dimension (value, target): shares that sum to 1 over the values with tokens.

    ``shares`` gives values of a dimension their target share by name, such as {"source": {"web": 0.5}} (a null value
    is ''); the other values share the rest in proportion to their powered shares. A named value without tokens
    is passed over; if no other value is there for the rest, the named ones are scaled up to 1. 0 leaves a value out.
    """
    out = {}
    for d in DIMENSIONS:
        given = (shares or {}).get(d, {})
        if any(not 0 <= x <= 1 for x in given.values()) or sum(given.values()) > 1 + 1e-9:
            raise ValueError(f"the shares of {d} must be from 0 to 1 and sum up to 1 at most")
        sums = table.groupBy(d).agg(F.sum("tokens").alias("t")).where("t > 0").withColumn("p", F.pow("t", F.lit(powers[d])))
        if given:
            named = table.sparkSession.createDataFrame([(v, float(x)) for v, x in given.items()], f"{d} string, named double")
            sums = sums.join(F.broadcast(named), d, "left")  # as many as the caller names
        else:
            sums = sums.withColumn("named", F.lit(None).cast("double"))
        sums = stored(sums, "shares")
        total = sums.agg(F.coalesce(F.sum("named"), F.lit(0.0)).alias("given"), F.sum(F.when(F.col("named").isNull(), F.col("p"))).alias("rest"))  # one row
        target = F.when(F.col("named").isNull(), F.greatest(1 - F.col("given"), F.lit(0.0)) * F.col("p") / F.col("rest")).when(F.col("rest").isNull() & (F.col("given") > 0), F.col("named") / F.col("given")).otherwise(F.col("named"))
        out[d] = stored(sums.join(F.broadcast(total)).select(d, target.alias("target")), "target")
    return out


def rake(table: DataFrame, goals: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS, task_cells: int = TASK_CELLS, keep_share: float = 0.0) -> DataFrame:
    """The cells with ``weight``, fitted so that its sums meet the goals; 0 for cells without tokens or goal.

    With a ``keep_share``, weights are shares of that part of all tokens, and none exceeds its cell's tokens:
    a value with fewer tokens than its goal gets all it has, the others of its dimension share the rest in
    proportion to their goals, and cells below their bound are fitted to that.

    Ends when no sum of a sweep is further than ``tolerance`` from its goal, or after ``sweeps``. A table that
    was counted to have at most ``task_cells`` cells is fitted in one task; a larger one by joins, sweep by sweep.
    """
    if table.limit(task_cells + 1).count() > task_cells:
        return _rake_by_joins(table, goals, tolerance, sweeps, keep_share)
    rows = table
    for d in DIMENSIONS:
        rows = rows.join(goals[d].withColumnRenamed("target", f"goal_{d}"), d, "left")

    def fit(cells: pd.DataFrame) -> pd.DataFrame:
        weight = cells["tokens"].to_numpy(float)
        weight = weight / (weight.sum() or 1.0)
        bound = weight / keep_share if keep_share else np.full(len(weight), np.inf)
        codes, wanted = {}, {}
        for d in DIMENSIONS:
            first, codes[d] = np.unique(cells[d].to_numpy(str), return_index=True, return_inverse=True)[1:]
            codes[d] = codes[d].ravel()
            wanted[d] = attainable(cells[f"goal_{d}"].fillna(0.0).to_numpy(float)[first], np.bincount(codes[d], bound))
        for _ in range(sweeps):
            off = 0.0
            for d in DIMENSIONS:
                full = weight >= bound
                now, free, held = (np.bincount(codes[d], x) for x in (weight, np.where(full, 0, weight), np.where(full & (bound < np.inf), bound, 0)))
                met = held + free
                # A Newton step: what full cells hold stays, the others make up the rest.
                step = np.divide(wanted[d] - held, free, out=np.zeros_like(now), where=free > 0)
                plain = np.divide(wanted[d], now, out=np.zeros_like(now), where=now > 0)
                close = np.abs(wanted[d] - met) <= 1e-12 * met
                weight = weight * np.where(close, 1.0, np.where(step > 0, step, plain))[codes[d]]
                off = max([off, *np.abs(wanted[d][met > 0] / met[met > 0] - 1)])
            if off <= tolerance:
                break
        return cells[[*DIMENSIONS, "tokens", "docs"]].assign(weight=np.minimum(weight, bound))

    schema = "source string, lang string, topic string, tokens long, docs long, weight double"
    return stored(rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, schema), "cells")


def attainable(goal: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The goals, none above its room; what is missed there is shared by the others in proportion to their goals."""
    scale = 1.0
    while True:
        over = goal * scale >= room
        rest, free = 1 - room[over].sum(), goal[~over].sum()
        if not over.any() or free <= 0 or rest / free <= scale * (1 + 1e-12):
            return np.minimum(goal * scale, room)
        scale = rest / free


def _attainable_rows(table: DataFrame, goals: DataFrame, d: str, total: float, keep_share: float) -> DataFrame:
    """``attainable`` where the values of a dimension aren't gathered: one sum over them a step."""
    rows = stored(goals.join(table.groupBy(d).agg((F.sum("tokens") / (total * keep_share)).alias("room")), d), "rooms")
    scale = 1.0
    while True:
        over = F.col("target") * scale >= F.col("room")
        held, free = rows.agg(F.sum(F.when(over, F.col("room"))), F.sum(F.when(~over, F.col("target")))).first()
        if held is None or not free or (1 - held) / free <= scale * (1 + 1e-12):
            return rows.select(d, F.least(F.col("target") * scale, "room").alias("target"))
        scale = (1 - held) / free


def _rake_by_joins(table: DataFrame, goals: dict[str, DataFrame], tolerance: float, sweeps: int, keep_share: float = 0.0) -> DataFrame:
    total = float(table.agg(F.sum("tokens")).first()[0] or 0) or 1.0
    bound = F.col("tokens") / (total * keep_share) if keep_share else F.lit(float("inf"))
    fitted = stored(table.withColumn("weight", F.col("tokens") / total), "cells")
    if keep_share:
        goals = {d: stored(_attainable_rows(table, goals[d], d, total, keep_share), "target") for d in DIMENSIONS}
    for _ in range(sweeps):
        fitted = fitted.withColumn("off", F.lit(0.0))
        for d in DIMENSIONS:
            full = F.col("weight") >= bound
            part = lambda x: F.coalesce(F.sum(x), F.lit(0.0))
            sums = fitted.groupBy(d).agg(F.sum("weight").alias("now"), part(F.when(~full, F.col("weight"))).alias("free"), part(F.when(full, bound)).alias("held")).join(goals[d], d, "left")
            sums = sums.withColumn("target", F.coalesce("target", F.lit(0.0))).withColumn("met", F.col("held") + F.col("free"))
            step = F.when((F.col("free") > 0) & (F.col("target") > F.col("held")), (F.col("target") - F.col("held")) / F.col("free"))
            plain = F.when(F.col("now") > 0, F.col("target") / F.col("now")).otherwise(0.0)
            close = F.abs(F.col("target") - F.col("met")) <= 1e-12 * F.col("met")
            off = F.when(F.col("met") > 0, F.abs(F.col("target") / F.col("met") - 1)).otherwise(0.0)
            factor = sums.select(d, F.when(close, 1.0).otherwise(F.coalesce(step, plain)).alias("f"), off.alias("_off"))
            fitted = fitted.join(factor, d).withColumn("weight", F.col("weight") * F.col("f")).withColumn("off", F.greatest("off", "_off")).drop("f", "_off")
        fitted = stored(fitted, "cells")
        if (fitted.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return fitted.drop("off").withColumn("weight", F.least("weight", bound))


def probabilities(table: DataFrame, goals: dict[str, DataFrame], keep_share: float = KEEP_SHARE, task_cells: int = TASK_CELLS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The raked cells with ``probability``: proportional to weight / tokens, in expectation a share of all tokens.

    The share is ``keep_share``; where that is 1, the largest at which every target is met exactly, or
    ``least_share`` if rare cells would make it less than that. Where a cell's tokens don't suffice for the share,
    its probability is 1 and the other cells are raked to what remains of the targets.
    """
    fitted = rake(table, goals, task_cells=task_cells)
    total, top = fitted.agg(F.sum("tokens"), F.max(F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")))).first()
    exact = 1 / (total * top) if top else 1.0
    share = keep_share if keep_share < 1 else max(exact, least_share)
    if share > exact:
        fitted = rake(table, goals, task_cells=task_cells, keep_share=share)
    drawn = F.col("weight") / F.col("tokens") * float((total or 0) * share)
    return fitted.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), drawn)).otherwise(1.0))


def reached(fitted: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """(dimension, value, target, share): of every target, what share of the drawn tokens its value has in expectation."""
    drawn = F.col("tokens") * F.col("probability")
    total = fitted.agg(F.sum(drawn).alias("all"))  # one row
    out = None
    for d in DIMENSIONS:
        sums = fitted.groupBy(d).agg(F.sum(drawn).alias("t")).join(goals[d], d).join(F.broadcast(total))
        rows = sums.select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "target", (F.col("t") / F.col("all")).alias("share"))
        out = rows if out is None else out.union(rows)
    return out


def uniform(seed: int) -> Column:
    """A number in [0, 1) from the row's id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") / float(1 << 53)


def calibrated(docs: DataFrame, powers: dict[str, float] = POWERS, keep_share: float = KEEP_SHARE, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """``docs`` with _llm_topic, _llm_probability and _llm_weight, the token weight of the row's cell.

    Documents without words are in no one's way: cells without tokens have probability 1. Repeated rows of
    one id and text are drawn together. Very long texts are counted whole. An empty table stays empty. Other
    columns stay, but for those whose names start with _llm_. ``shares`` are explicit targets, see ``targets``: as many tokens are drawn as meet them exactly.
    """
    table = stored(cells(docs), "cells")
    fitted = probabilities(table, targets(table, powers, shares), keep_share, least_share=0.0 if shares else LEAST_SHARE)
    fitted = stored(fitted.select(*[F.col(c).alias(f"_llm_{c}") for c in DIMENSIONS], F.col("probability").alias("_llm_probability"), F.col("weight").alias("_llm_weight")), "probabilities")
    fitted = small(fitted.withColumnRenamed("_llm_topic", "_llm_kind"))
    rows = docs.withColumn("_llm_topic", topic())
    same = (F.coalesce(rows["source"], F.lit("")) == F.col("_llm_source")) & (F.coalesce(rows["lang"], F.lit("")) == F.col("_llm_lang")) & (F.col("_llm_topic") == F.col("_llm_kind"))
    return rows.join(fitted, same, "left").drop("_llm_source", "_llm_lang", "_llm_kind")


def mixed(docs: DataFrame, powers: dict[str, float] = POWERS, keep_share: float = KEEP_SHARE, seed: int = 17, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The drawn rows of ``docs``, columns as before."""
    return calibrated(docs, powers, keep_share, shares).where(uniform(seed) < F.col("_llm_probability")).select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = calibrated(docs)
    drawn = uniform(17) < F.col("_llm_probability")
    return rows.select("doc_id", n_tokens().alias("n_tokens"), F.col("_llm_topic").alias("topic"), F.col("_llm_weight").alias("cell_weight"), F.col("_llm_probability").alias("probability"), drawn.alias("drawn"))
