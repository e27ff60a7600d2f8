"""The pipeline on the smallest tables: what each stage keeps, and that it ends in packed pieces."""

import os
import random
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pyspark
from framequarry.llm import jaccard
from framequarry.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, seen = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        if name == "near_duplicates":
            got = {r.doc_id: r.component_id for r in jaccard.cluster(before).collect()}
            assert {r.doc_id for r in docs.collect()} == {i for i, c in got.items() if i == c}
        if name in ("language", "lines"):
            assert docs.count() >= 0.9 * seen
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "pack"]


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns[:2] == ["doc_id", "start"]


def test_near_copies_keep_their_lines_until_they_are_one(spark):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(12))
    group = [line() for _ in range(40)]
    pages = ["\n".join([*group[: k % 40], line(), *group[k % 40 + 1 :]]) for k in range(60)]
    site = ["\n".join(["menu of the site", *[line() for _ in range(6)]]) for _ in range(240)]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(pages + site)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.written(corpus_pipeline.lines(spark, docs, SF), "lines")
    got = {r.doc_id: r.text for r in clean.collect()}
    assert all(got[i] == t for i, t in enumerate(pages))
    assert all("menu" not in got[60 + i] for i in range(240))
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, clean, SF).collect()}
    assert left == {0, *range(60, 300)}


def test_rows_grow_with_a_group_and_not_its_square(spark, monkeypatch):
    rows = []
    write = jaccard.written

    def counted(df, name, keep=False):
        out = write(df, name, keep)
        if name == "tiled":
            rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    for m in (600, 1200):
        texts = [(i, " ".join([*(f"w{k}" for k in range(60)), f"tail{i}"]), "en", "a", 0) for i in range(m)]
        docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
        assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [0]
    assert rows[0] >= 600 and rows[1] <= 2.2 * rows[0]


#: In a cluster of one executor: MB of its JVM after a step that leaves garbage, and after a stage has begun.
STARTS = """
import re, sys
from pathlib import Path
from pyspark.sql import SparkSession
import corpus_pipeline
from framequarry.llm.common import table
spark = (SparkSession.builder.master("local-cluster[1,1,1200]").config("spark.executor.memory", "1200m").config("spark.ui.enabled", "false")
    .config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate())

def mb():
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if "org.apache.spark.executor.CoarseGrainedExecutorBackend" in (p / "cmdline").read_text().split("\\0") and sys.argv[1] in (p / "environ").read_text():
                return sum(map(int, re.findall(r"Pss_Anon: +([0-9]+)", (p / "smaps_rollup").read_text()))) // 1024
        except OSError:  # it has ended meanwhile
            pass

docs = table(spark, sys.argv[2], "documents").limit(20)
for name, stage in corpus_pipeline.STAGES:
    if name in ("language", "mix", "pack"):
        spark.range(0, 4_000_000, 1, 1).selectExpr("id % 2 as k", "cast(id as string) as s").groupBy("k").agg({"s": "collect_list"}).write.format("noop").mode("overwrite").save()
        before = mb()
        stage(spark, docs, sys.argv[2])
        print("MB", name, before, mb())
"""


def test_a_stage_begins_without_the_garbage_of_others(tmp_path):
    home = tmp_path / "home"
    (home / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":  # where executors work
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYTHONPATH": str(Path(corpus_pipeline.__file__).parent)}
    env = {k: v for k, v in env.items() if k not in ("PYSPARK_SUBMIT_ARGS", "SPARK_CONF_DIR", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    got = subprocess.run([sys.executable, "-c", STARTS, str(tmp_path), SF], env=env, capture_output=True, text=True, timeout=300)
    rows = [x.split()[1:] for x in got.stdout.splitlines() if x.startswith("MB ")]
    assert [r[0] for r in rows] == ["language", "mix", "pack"], got.stderr[-2000:]
    assert all(int(after) <= 0.75 * int(before) for _, before, after in rows), rows
