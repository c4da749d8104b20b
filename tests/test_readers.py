"""Readers of files: JSON arrays over many splits, error lists, titles, the skill catalog."""
import json
import random

import pytest
from pyspark.sql import functions as F

from tracemill.sources import rollouts as L
from tracemill.sources import tables as B
from tracemill.sources.json_arrays import read_array_items


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def some(r, depth=0):
    odd = ["", "}", "{", "]}", 'q"}{', "\\", "a\\\\", "é🙂", "x\ny", "[{", ","]
    kind = r.randrange(6 if depth < 3 else 3)
    if kind < 2:
        return r.choice(odd) * r.randrange(1, 4)
    if kind == 2:
        return r.choice([1, -2.5, True, None])
    if kind == 3:
        return [some(r, depth + 1) for _ in range(r.randrange(3))]
    return {f"k{j}{r.choice(['', '}', '{'])}": some(r, depth + 1) for j in range(r.randrange(4))}


def test_array_items_equal_a_whole_read(spark, tmp_path, small_splits):
    r = random.Random(5)
    want = {}
    for n in range(6):
        items = [{"id": k, "v": some(r)} for k in range(r.randrange(1, 60))]
        text = json.dumps(items, indent=[None, 1, 2][n % 3], ensure_ascii=n % 2 == 0, separators=(",", ":") if n == 3 else None)
        (tmp_path / f"f{n}.json").write_text(text + "\n" * (n % 2), encoding="utf-8")
        want[f"f{n}.json"] = items
    for name, text in (("empty.json", "[]"), ("nothing.json", ""), ("cut.json", '[{"id":0},{"id":1},{"id":2,"v":"x'), ("mixed.json", '[1, {"id":0}, [2], {"id":1}]')):
        (tmp_path / name).write_text(text)
    want |= {"cut.json": [{"id": 0}, {"id": 1}], "mixed.json": [{"id": 0}, {"id": 1}]}
    rows = read_array_items(spark, str(tmp_path))
    got = {}
    for x in sorted(rows.collect(), key=lambda x: (x.path, x.ordinal)):
        got.setdefault(x.path.rsplit("/", 1)[-1], []).append(json.loads(x.item))
    assert got == want
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10


def test_error_lists_of_both_forms(spark, tmp_path, small_splits):
    records = [{"run_id": f"r{k}", "message": f"boom {k} }}", "category": "net", "count": k, "extra": {"a": [k]}} for k in range(40)]
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, records)) + "\nnot json\n")
    (tmp_path / "array.json").write_text(json.dumps(records, indent=2))
    read = lambda df: [(r.run_id, r.message, r.category, r["count"]) for r in df.orderBy("ordinal").collect()]
    want = [(x["run_id"], x["message"], x["category"], str(x["count"])) for x in records]
    assert read(B.read_error_lines(spark, str(tmp_path / "lines.json"))) == want == read(B.read_error_array(spark, str(tmp_path / "array.json")))


def test_titles_of_an_index_file(spark, tmp_path):
    (tmp_path / "index.jsonl").write_text('{"id":"a","thread_name":"old"}\n{"id":"b","title":"B"}\n{"session_id":"a","name":"new"}\n{"id":"c"}\n')
    assert {(r.session_id, r.title) for r in L.read_titles(spark, str(tmp_path)).collect()} == {("a", "new"), ("b", "B")}


def test_skill_catalog_from_files(spark, tmp_path):
    for name, body in (("one", '---\nname: "Named"\n---\n'), (".archive/two", "no front matter")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "SKILL.md").write_text(body)
    off = spark.createDataFrame([(0, "two")], "tenant_id long, name string")
    rows = {r.name: r for r in B.read_skill_catalog(spark, str(tmp_path), F.current_timestamp(), disabled=off).collect()}
    assert set(rows) == {"Named", "two"} and rows["two"].archived and rows["two"].disabled and rows["Named"].installed and not rows["Named"].disabled
