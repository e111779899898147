import random
from types import SimpleNamespace as Plain

import pyarrow as pa
import pytest

from tidemark.llm import common as m


@pytest.mark.parametrize("hot_share", [1, 3, 1000])
def test_skew_join_equals_a_plain_join(spark, hot_share):
    rng = random.Random(0)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i % 2) for i in range(600)]
    lookup = [(k, b, f"{k}{b}") for k in ["hot", "unused", *(f"k{i}" for i in range(30))] for b in (0, 1)]
    left, right = spark.createDataFrame(rows, "i long, k string, b long"), spark.createDataFrame(lookup, "k string, b long, v string")
    known = {(k, b): v for k, b, v in lookup}
    want = sorted((i, known[k, b]) for i, k, b in rows if (k, b) in known)
    assert sorted((r.i, r.v) for r in m.skew_join(left, right, "k", "b", hot_share=hot_share).collect()) == want
    assert m.skew_join(left.limit(0), right, "k", "b").collect() == []


def test_a_cluster_has_to_name_its_shared_folder():
    conf = Plain(get=lambda *a: None)
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]"):
        context = Plain(master=master, getConf=lambda: conf)
        with pytest.raises(ValueError):
            m.shared_dir(Plain(sparkContext=context, conf=conf))


def test_slices_cut_by_text_and_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"i": list(range(9)), "t": ["x" * n for n in (0, 5, 200, 3, 3, 3, 90, 0, 1)]})
    parts = list(m.slices(batch, 100))
    assert [r for p in parts for r in p.column("i").to_pylist()] == list(range(9))
    assert all(sum(map(len, p.column("t").to_pylist())) <= 100 or p.num_rows == 1 for p in parts)
    assert list(m.slices(batch.slice(0, 0), 100)) == []


def test_slices_count_binary_columns():
    batch = pa.RecordBatch.from_pydict({"i": [0, 1, 2], "b": [b"x" * 90, None, b"y" * 90]})
    assert [p.column("i").to_pylist() for p in m.slices(batch, 100)] == [[0, 1], [2]]


def test_fresh_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, 2)], "Key int, key_ int")
    assert m.fresh(df, "key") == "key__"


def test_only_a_written_table_of_the_shared_folder_is_discarded(spark, tmp_path):
    from pathlib import Path

    written = m.materialize(spark.range(9), "discard-test")
    folder = Path(written.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    m.discard(written)
    assert not folder.exists()
    spark.range(3).write.parquet(str(tmp_path / "own"))
    m.discard(spark.read.parquet(str(tmp_path / "own")))
    assert (tmp_path / "own").exists()
