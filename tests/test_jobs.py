"""The jobs from files to files, by their main()."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from seqtrend.functions import mutations
from seqtrend.jobs import evaluate, make_pairs, normalise
from seqtrend.operators import series
from seqtrend.sources import tables

REFERENCE = "ACDEFGHIKLMNPQRSTVWY" * 3 + "*"
VARIANTS = ["", *(f"{REFERENCE[i - 1]}{i}{a}" for i in range(1, 15) for a in "WYV" if REFERENCE[i - 1] != a)]


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    """A raw table, records of half its rows of which some disagree, and the reference."""
    rng, out = random.Random(3), tmp_path_factory.mktemp("raw")
    lines, records = ["\t".join(tables.RAW)], []
    for i in range(2500):
        m = VARIANTS[min(int(rng.expovariate(0.12)), len(VARIANTS) - 1)]
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randint(VARIANTS.index(m) * 3 % 60, 200))
        place = rng.choice(["Europe / X", "Asia / Y"])
        lines.append("\t".join([f"EPI_ISL_{i}", f"v{i}", "Human", place, day.isoformat(), day.isoformat(), "L", f"(Spike_{m})" if m else "()"]))
        if i % 2:
            seq = mutations.mutated(m, REFERENCE)
            records.append(f">v|EPI_ISL_{i}|x\n{seq if i % 3 else 'C' + seq[1:]}\n")
    for name, text in (("raw.tsv", "\n".join(lines) + "\n"), ("records.fasta", "".join(records)), ("reference.txt", REFERENCE)):
        (out / name).write_text(text)
    normalise.main([str(out / "raw.tsv"), str(out / "plain")])
    return out


def pair_rows(spark, path):
    rows = spark.read.schema(tables.PAIR + ", split string").json(str(path)).select("seq0", "count0", "seq1", "count1", "period", "split").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_normalise(spark, raw):
    normalise.main([str(raw / "raw.tsv"), str(raw / "labelled"), "--fasta", str(raw / "records.fasta"), "--reference", str(raw / "reference.txt")])
    rows = tables.load_normalised(spark, str(raw / "labelled"), labelled=True)
    got = {int(r.acc.split("_")[-1]): r.reconstructed for r in rows.collect()}
    assert len(got) == 2500 and not any(ok for i, ok in got.items() if i % 2 == 0)
    assert sum(got.values()) >= 2500 // 2 - 2500 // 6 - 1 and not all(got[i] for i in got if i % 2)
    assert series.usable(rows, "reconstructed").count() == sum(got.values())
    assert tables.load_normalised(spark, str(raw / "plain"), labelled=True).where("reconstructed is not null").isEmpty()


def test_refresh(spark, raw, tmp_path):
    path, rows = str(tmp_path / "t"), tables.load_normalised(spark, str(raw / "plain")).cache()
    tables.write_normalised(rows.where("d < '2024-07-01'"), path)
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    assert tables.refresh_normalised(rows.where("d < '2024-07-01'").repartition(5), path).collect() == [] and files() == before
    late = F.when(F.col("acc") == "EPI_ISL_5", None).otherwise(F.col("d"))
    second = rows.where("d >= '2024-02-01'").withColumn("d", late)
    day = rows.where("acc = 'EPI_ISL_5'").first().d
    changes = {r.month: r.change for r in tables.refresh_normalised(second, path).collect()}
    assert changes == {"2024-01": "removed", "2024-07": "written", None: "written", f"{day:%Y-%m}": "removed" if day.month == 1 else "written"}
    kept = {f: t for f, t in files().items() if f.split("/")[0].removeprefix("month=") not in (*changes, "__HIVE_DEFAULT_PARTITION__")}
    assert kept and all(before[f] == t for f, t in kept.items())
    assert sorted(map(str, tables.load_normalised(spark, path).collect())) == sorted(map(str, second.collect()))


def test_pairs(spark, raw):
    until = "2024-07-10"
    common = [str(raw / "plain"), str(raw / "one"), "--until", until, "--primary", "Europe", "--cap", "750"]
    make_pairs.main(common)
    obs = tables.load_normalised(spark, str(raw / "plain"), end=until)
    first = obs.agg(F.min("d")).first()[0]
    last = (datetime.date.fromisoformat(until) - first).days // 7
    assert make_pairs.last_week_of(obs, until) == last
    made = make_pairs.run(obs, "Europe", last_week=last).select("seq0", "count0", "seq1", "count1", "period", "split")
    got = pair_rows(spark, raw / "one")
    assert got == sorted((tuple(r) for r in made.collect()), key=str) and len(got) > 10 and {r[-1] for r in got} == {"train", "val"}
    assert all(r[3] <= r[1] for r in got)


def test_pairs_of_two_regions_and_all_options(spark, raw):
    rows = {}
    for name, more in (
        ("union", ["--combine", "union", "--max-p-diff", "0.4"]),
        ("inter", ["--combine", "intersection", "--max-p-diff", "0.4"]),
        ("strict", ["--combine", "intersection", "--p-value", "0.9", "--cutoff", "0.0"]),
        ("chi2", ["--combine", "intersection", "--p-value", "0.1", "--chi2", "--min-lead", "12"]),
        ("lists", ["--combine", "union", "--max-p-diff", "0.4", "--frequent", "150", "20", "1", "5", "--mutations", "2", "--trials", "2", "1", "--blocks", "2", "1", "1"]),
        ("capped", ["--combine", "union", "--max-p-diff", "0.4", "--max-rows", "7", "3", "0", "--discovery", "2024-03-01", "--period", "14"]),
    ):
        make_pairs.main([str(raw / "plain"), str(raw / name), "--until", "2024-07-15", "--primary", "Europe", "--control", "~Europe", *more])
        rows[name] = pair_rows(spark, raw / name)
    assert set(rows["strict"]) < set(rows["inter"]) and rows["inter"] and rows["chi2"]
    assert all(r[4] >= 12 for r in rows["chi2"])
    assert {r[-1] for r in rows["lists"]} == {"train", "val", "test"} and any(r[3] == 0 for r in rows["lists"]) and any(r[4] is None and r[3] > 0 for r in rows["lists"])
    known = set(VARIANTS)
    assert all(r[2] not in known for r in rows["lists"] if r[3] == 0)
    assert 0 < len([r for r in rows["capped"] if r[-1] == "train"]) <= 7 and len(rows["capped"]) <= 10


def test_pairs_of_given_splits_and_randomizations(spark, raw):
    for name, part in (("train", VARIANTS[:12]), ("val", VARIANTS[10:24]), ("test", VARIANTS[24:])):
        (raw / f"{name}.txt").write_text("".join(m + "\n" for m in part))
    base = ["--until", "2024-07-15", "--primary", "Europe"]
    make_pairs.main([str(raw / "plain"), str(raw / "given"), *base, "--given", *(str(raw / f"{x}.txt") for x in ("train", "val", "test"))])
    got = pair_rows(spark, raw / "given")
    part = {m: "train" if i < 12 else "val" if i < 24 else "test" for i, m in enumerate(VARIANTS)}
    assert got and all(part[r[0]] == part[r[2]] == r[-1] for r in got)
    make_pairs.main([str(raw / "plain"), str(raw / "many"), *base, "--randomizations", "2"])
    assert pair_rows(spark, raw / "many" / "run=0") != pair_rows(spark, raw / "many" / "run=1")
    with pytest.raises(SystemExit):
        make_pairs.main([str(raw / "plain"), str(raw / "no"), *base, "--given", "a", "b", "c", "--randomizations", "2"])


def test_evaluate(spark, raw):
    rng = random.Random(9)
    (raw / "samples").mkdir()
    sizes = {}
    for tool in "ab":
        for k in range(3):
            known = [mutations.mutated(rng.choice(VARIANTS), REFERENCE) for _ in range(12)]
            made = ["".join(rng.choices("ACDEFGHIK", k=60)) + "*" for _ in range(4 + k)] + ["bad"]
            lines = [{"seq": s, "ll": -float(i)} for i, s in enumerate(known + made)]
            (raw / "samples" / f"{tool}-{k}.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
            sizes[f"{tool}-{k}.json"] = len(set(known)) + 4 + k
    (raw / "tools.json").write_text("".join(json.dumps({"run": r, "tool": r[0], "setting": "0.9"}) + "\n" for r in sizes))
    out = raw / "evaluated"
    evaluate.main([str(raw / "samples"), str(raw / "plain"), str(raw / "reference.txt"), str(out), "--cutoff", "2024-03-01", "--tools", str(raw / "tools.json"), "--weeks", "5", "--periods", "2"])
    read = lambda name: spark.read.parquet(str(out / name))
    assert {r.run: r.n_valid for r in read("stats").collect()} == sizes
    means = {(r.tool, r.setting, r.figure): (r["mean"], r.n) for r in read("means").collect()}
    for tool in "ab":
        mine = [n for r, n in sizes.items() if r[0] == tool]
        assert means[tool, "0.9", "n_valid"] == (pytest.approx(sum(mine) / 3), 3)
    assert len(means) == 2 * 14
    places = read("curve_means").where("kind = 'ALL' and figure = 'tp' and tool = 'a'").orderBy("place").collect()
    shortest = min(read("curves").where("kind = 'ALL' and run like 'a-%'").groupBy("run").count().collect(), key=lambda r: r["count"])["count"]
    assert [r.place for r in places] == list(range(1, shortest + 1)) and all(r.n == 3 for r in places)
    kinds = {(r.kind, r.period) for r in read("period_means").collect()}
    assert kinds == {("week", i) for i in range(1, 6)} | {("period", 1), ("period", 2)}
    assert read("classified").where("invalid_seq").count() == 6
