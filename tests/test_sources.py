from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.sources import tables


def test_front_matter_and_loader(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\nid: x1\ntitle: "A: b"\nfiscal_year: 2024\nlast_modified: 2024-05-01\n---\n\n# A\nbody\n')
    (tmp_path / "b.bin").write_text("no")
    d = tables.read_documents(spark, str(tmp_path))
    r = d.select("source_path", *tables.front_matter(F.col("content"))).collect()
    assert len(r) == 1 and r[0].id == "x1" and r[0].title == "A: b" and r[0].fiscal_year == 2024 and str(r[0].last_modified) == "2024-05-01" and r[0].author is None and r[0].body.startswith("# A")


def test_keyed_tables_and_logs(spark, tmp_path):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "chunk_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], t.schema)
    assert sorted(tuple(r) for r in tables.upserted(t, new).collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert [r.chunk_id for r in tables.deleted(t, new).collect()] == ["a"]
    for _ in range(2):
        tables.append_json(t, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
