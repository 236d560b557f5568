"""The jobs: growing input over two runs, broken runs, odd rows, formats, command lines; their rows against plain Python."""

import json
import logging
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, dialogue_watch, network_atlas

REPO = Path(__file__).resolve().parents[1]
TURNS = "conv_id bigint, turn bigint, role string, text string"
FIRST = [(1, 0, "user", "A tion and\n\n  the start of it"), (1, 1, "assistant", "no hit"), (2, 0, "system", "TION tion THE END"), (3, 0, "user", None), (None, 0, None, "the end of a line " * 20), (4, 0, "user", "")]
SECOND = [(1, 2, "user", "x" * 90 + " the station " + "y" * 90), (5, 0, "user", "🎉" * 50 + "the tion"), (None, 1, "user", "the the the"), (3, 0, "user", "station")]


def add(spark, rows, path):
    spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(path)


def brute(rows, settings=dialogue_watch.DEFAULTS):
    hits, sessions = Counter(), {}
    width = settings["width"]
    for conv, turn, role, text in rows:
        text = text or ""
        s = sessions.setdefault(conv, defaultdict(int) | {"first_turn": turn, "last_turn": turn})
        s["turns"] += 1
        s["characters"] += len(text)
        s["first_turn"], s["last_turn"] = min(s["first_turn"], turn), max(s["last_turn"], turn)
        s[f"{role}_turns"] += 1
        flat = re.sub("[ \t\n\r]+", " ", text).strip(" ")
        for search in settings["searches"]:
            found = list(re.finditer(search["pattern"], flat, re.I | re.A))
            if found and search["role"] in (None, role):
                at = max(found[0].start() - width // 3, 0)
                cut = ("..." if at else "") + flat[at : at + width] + ("..." if at + width < len(flat) else "")
                hits[(conv, turn, role, search["name"], len(found), cut)] += 1
                s[f"{search['name']}_places"] += len(found)
    names = ["turns", "characters", "first_turn", "last_turn", *(f"{r}_turns" for r in settings["roles"]), *(f"{x['name']}_places" for x in settings["searches"])]
    return hits, {c: tuple(s[n] for n in names) for c, s in sessions.items()}


def found(spark, output, settings=None):
    hits, sessions = dialogue_watch.result(spark, output, settings)
    names = [c for c in sessions.columns if c not in ("conv_id", "bucket")]
    rows = sessions.select("conv_id", *names).collect()
    assert len(rows) == len({r[0] for r in rows})
    return Counter(tuple(r) for r in hits.select("conv_id", "turn", "role", "search", "places", "extract").collect()), {r[0]: tuple(r)[1:] for r in rows}


def watch(spark, tmp_path, settings=None):
    return dialogue_watch.run(spark, f"{tmp_path}/turns", f"{tmp_path}/out", f"{tmp_path}/checkpoint", settings)


def test_two_runs_take_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, logger="jobs")
    add(spark, FIRST, f"{tmp_path}/turns")
    assert watch(spark, tmp_path) == {"batches": 1, "turns": len(FIRST), "hits": sum(brute(FIRST)[0].values())}
    assert found(spark, f"{tmp_path}/out") == brute(FIRST)
    add(spark, SECOND, f"{tmp_path}/turns")
    assert watch(spark, tmp_path) == {"batches": 1, "turns": len(SECOND), "hits": sum(brute(SECOND)[0].values())}
    assert found(spark, f"{tmp_path}/out") == brute(FIRST + SECOND)
    assert watch(spark, tmp_path) == {"batches": 0, "turns": 0, "hits": 0}
    assert found(spark, f"{tmp_path}/out") == brute(FIRST + SECOND)
    assert f"read {len(SECOND)} new turns" in caplog.text and "wrote" in caplog.text


def test_untouched_buckets_stay_as_they_are(spark, tmp_path):
    add(spark, [(i, 0, "user", "tion") for i in range(50)], f"{tmp_path}/turns")
    watch(spark, tmp_path)
    files = lambda: {str(p) for p in Path(f"{tmp_path}/out/sessions").rglob("*.parquet")}
    before = files()
    add(spark, [(7, 1, "user", "tion")], f"{tmp_path}/turns")
    watch(spark, tmp_path)
    assert len(before - files()) < len(before) / 4


@pytest.mark.parametrize("step", ["shares", "merged"])
def test_a_batch_that_broke_off_is_repeated(spark, tmp_path, monkeypatch, step):
    add(spark, FIRST, f"{tmp_path}/turns")
    watch(spark, tmp_path)
    add(spark, SECOND, f"{tmp_path}/turns")

    def breaks(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(dialogue_watch, step, breaks)
        with pytest.raises(Exception, match="lost"):
            watch(spark, tmp_path)
    assert watch(spark, tmp_path)["turns"] == len(SECOND)
    assert found(spark, f"{tmp_path}/out") == brute(FIRST + SECOND)


def test_many_batches_give_the_same(spark, tmp_path):
    rows = [(i % 7, i, ("user", "assistant")[i % 2], "the tion " * (i % 3)) for i in range(60)]
    for at in range(0, 60, 10):
        add(spark, rows[at : at + 10], f"{tmp_path}/turns")
    settings = {"files_per_batch": 1, "buckets": 2, "searches": [{"name": "t", "pattern": "t[a-z]", "role": "assistant"}]}
    assert watch(spark, tmp_path, settings)["batches"] == 6
    assert found(spark, f"{tmp_path}/out", settings) == brute(rows, {**dialogue_watch.DEFAULTS, **settings})


def test_a_single_file_an_empty_table_and_other_columns(spark, tmp_path):
    add(spark, FIRST, f"{tmp_path}/one")
    file = next(Path(f"{tmp_path}/one").glob("*.parquet"))
    dialogue_watch.run(spark, str(file), f"{tmp_path}/out1", f"{tmp_path}/c1")
    assert found(spark, f"{tmp_path}/out1") == brute(FIRST)
    add(spark, [], f"{tmp_path}/none")
    dialogue_watch.run(spark, f"{tmp_path}/none", f"{tmp_path}/out2", f"{tmp_path}/c2")
    assert found(spark, f"{tmp_path}/out2") == (Counter(), {})
    more = spark.createDataFrame(FIRST, TURNS).withColumns({c: F.lit("x") for c in ("search", "batch", "bucket", "places", "of")})
    more.write.parquet(f"{tmp_path}/more")
    dialogue_watch.run(spark, f"{tmp_path}/more", f"{tmp_path}/out3", f"{tmp_path}/c3")
    assert found(spark, f"{tmp_path}/out3") == brute(FIRST)


def test_unknown_settings_raise():
    with pytest.raises(ValueError, match="buckts"):
        common.config(dialogue_watch.DEFAULTS, {"buckts": 3})
    for job in (dialogue_watch, network_atlas):
        with open(REPO / "jobs" / f"{job.__name__.rpartition('.')[2]}.json") as f:
            assert json.load(f) == job.DEFAULTS


DRAWS = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, other string"


def atlas_rows(spark, output, settings=None):
    return {t: Counter(tuple(r) for r in network_atlas.table(spark, output, t, settings).collect()) for t in network_atlas.SCHEMAS}


def test_atlas_of_all_networks_has_the_published_counts(spark, tmp_path):
    every = spark.range(32**3).selectExpr("id % 32 AS l_orderkey", "id DIV 32 % 32 AS l_partkey", "id DIV 1024 AS l_suppkey")
    every.write.parquet(f"{tmp_path}/draws")
    assert network_atlas.run(spark, f"{tmp_path}/draws", f"{tmp_path}/out") == {"draws": 32768, "networks": 32768, "edges": 451584, "vectors": 10}
    nets = network_atlas.table(spark, f"{tmp_path}/out", "networks")
    assert nets.where("leaves > 1").count() == 2977 and nets.agg(F.sum("degree")).first()[0] == 2 * 451584
    realized = [F.expr(f"substring(f_{j}, s + 1, 1) = IF({' + '.join(f'`w_{i},{j}` * (shiftright(s, {i - 1}) & 1)' for i in (1, 2, 3))} > 0, '1', '0')") for j in (1, 2, 3)]
    wrong = nets.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(7)))).where(~(realized[0] & realized[1] & realized[2]))
    assert wrong.count() == 0


def test_atlas_reruns_grow_and_formats(spark, tmp_path):
    rows = [(i, i * 7 % 40, i * i % 33, "x") for i in range(200)] + [(None, 1, 1, "x"), (-1, -2, -3, "x"), (31, 30, 29, "x")]
    spark.createDataFrame(rows, DRAWS).write.parquet(f"{tmp_path}/draws")
    first = network_atlas.run(spark, f"{tmp_path}/draws", f"{tmp_path}/out")
    kept = atlas_rows(spark, f"{tmp_path}/out")
    assert first["draws"] == len(rows) and first["networks"] == len({tuple(x % 32 for x in r[:3]) for r in rows if r[0] is not None})
    assert sum(r[-3] * n for r, n in kept["networks"].items()) == len(rows) - 1  # draws
    assert network_atlas.run(spark, f"{tmp_path}/draws", f"{tmp_path}/out") == first and atlas_rows(spark, f"{tmp_path}/out") == kept
    csv = {"format": "csv", "compression": "gzip"}
    network_atlas.run(spark, f"{tmp_path}/draws", f"{tmp_path}/csv", csv)
    assert atlas_rows(spark, f"{tmp_path}/csv", csv) == kept
    assert "v_3,v_2,v_1,v_0,f_1" in spark.read.text(f"{tmp_path}/csv/networks").where("value LIKE 'v_3%'").first()[0]
    spark.createDataFrame(rows[:5], DRAWS).write.mode("overwrite").parquet(f"{tmp_path}/draws")
    assert network_atlas.run(spark, f"{tmp_path}/draws", f"{tmp_path}/out")["networks"] == 5 == sum(atlas_rows(spark, f"{tmp_path}/out")["networks"].values())
    spark.createDataFrame([], DRAWS).write.mode("overwrite").parquet(f"{tmp_path}/draws")
    assert set(network_atlas.run(spark, f"{tmp_path}/draws", f"{tmp_path}/out").values()) == {0}
    assert not any(t.name.startswith("atlas_") for t in spark.catalog.listTables())


def test_atlas_after_a_run_that_broke_off(spark, tmp_path, monkeypatch):
    spark.range(300).selectExpr("id AS l_orderkey", "id * 3 AS l_partkey", "id * 5 AS l_suppkey").write.parquet(f"{tmp_path}/draws")
    network_atlas.run(spark, f"{tmp_path}/draws", f"{tmp_path}/whole")
    with monkeypatch.context() as m:
        m.setattr(network_atlas, "result_rows", lambda *_: "SELECT 1 AS v, raise_error('lost') || '' AS leaves")
        with pytest.raises(Exception, match="lost"):
            network_atlas.run(spark, f"{tmp_path}/draws", f"{tmp_path}/out")
    network_atlas.run(spark, f"{tmp_path}/draws", f"{tmp_path}/out")
    assert atlas_rows(spark, f"{tmp_path}/out") == atlas_rows(spark, f"{tmp_path}/whole")


@pytest.mark.parametrize("job, paths", [("dialogue_watch", ["turns", "output", "checkpoint"]), ("network_atlas", ["draws", "output"])])
def test_command_lines(spark, tmp_path, job, paths):
    add(spark, FIRST, f"{tmp_path}/turns")
    spark.createDataFrame([(1, 2, 3, "x")], DRAWS).write.parquet(f"{tmp_path}/draws")
    args = [x for p in paths for x in (f"--{p}", f"{tmp_path}/{p}")]
    ran = subprocess.run([sys.executable, "-m", f"jobs.{job}", *args, "--config", f"jobs/{job}.json"], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "wrote" in ran.stderr and Path(f"{tmp_path}/output").is_dir()
