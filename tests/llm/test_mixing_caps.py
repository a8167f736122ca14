from seqtrend.llm import mixing as S


def cell_table(spark, scale=1):
    rows = [(f"s{i}", f"l{j}", t, (100 + 37 * i * j + 900 * (i == j)) * (3 if t == "prose" else 1) * scale, 1) for i in range(6) for j in range(4) for t in ("prose", "table")]
    rows += [("", "l0", "prose", 300, 1), ("s0", "l0", "notice", 0, 1)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, docs long")


def kept(fitted):
    rows = fitted.collect()
    assert all(0 <= r.probability <= 1 for r in rows)
    return sum(r.tokens * r.probability for r in rows) / sum(r.tokens for r in rows)


def test_one_rare_row_does_not_shrink_the_draw(spark):
    """300 words of a null source beside a corpus of any size: half of the tokens stay, and all other targets are met."""
    for scale in (1, 1000):
        table = cell_table(spark, scale)
        goals = S.targets(table)
        fitted = S.probabilities(table, goals, 0.5)
        assert abs(kept(fitted) - 0.5) < 1e-4
        assert kept(S.probabilities(table, goals)) > S.LEAST_SHARE - 1e-4
        report = {(r.dimension, r.value): r for r in S.reached(fitted, goals).collect()}
        rare = report["source", ""]
        assert rare.share < rare.target if scale == 1000 else True
        more = [r.share / r.target for (d, v), r in report.items() if d == "source" and v]
        assert max(more) - min(more) < 1e-4 and abs(1 - rare.share - sum(r.share for (d, v), r in report.items() if d == "source" and v)) < 1e-9
        assert all(abs(r.share - r.target) < 1e-4 for (d, _), r in report.items() if d != "source")


def test_both_ways_agree_with_bounds(spark):
    table = cell_table(spark, 50)
    goals = S.targets(table)
    one, other = ({(r.source, r.lang, r.topic): r.probability for r in S.probabilities(table, goals, 0.6, task_cells=n).collect()} for n in (10_000, 0))
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 1e-6 for k in one)
    assert one["", "l0", "prose"] == 1 and one["s0", "l0", "notice"] == 1


def test_default_keeps_as_many_tokens_as_the_targets_allow(spark):
    table = cell_table(spark).where("source <> ''")
    goals = S.targets(table)
    fitted = S.probabilities(table, goals)
    assert kept(fitted) > 0.55 and abs(max(r.probability for r in fitted.where("tokens > 0").collect()) - 1) < 1e-9
    assert all(abs(r.share - r.target) < 1e-5 for r in S.reached(fitted, goals).collect())
