"""Record formats, and changes of snapshot tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import files, records
from millrace.sources.snapshots import SnapshotTable


def put(folder, name, text):
    (folder / name).write_text(text, newline="")
    return str(folder / name)


def test_geojson(spark, tmp_path):
    features = [{"type": "Feature", "id": 7, "geometry": {"type": "Point", "coordinates": [1, 2.5]}, "properties": {"name": "a", "n": 3}}, {"type": "Feature", "geometry": None, "properties": None}]
    path = put(tmp_path, "a.geojson", json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    first, second = sorted(records.read_geojson(spark, path).collect(), key=lambda r: r.feature_id is None)
    assert (first.feature_id, json.loads(first.geometry)["coordinates"], first.properties) == ("7", [1, 2.5], {"name": "a", "n": "3"})
    assert tuple(second) == (None, None, None)
    assert records.read_geojson(spark, path, "struct<n: long>").where("properties.n = 3").count() == 1
    for bad in ({"type": "Feature"}, {"type": "FeatureCollection", "features": [{"type": "Point"}]}):
        with pytest.raises(Exception, match="not a Feature"):
            records.read_geojson(spark, put(tmp_path, "bad.geojson", json.dumps(bad))).collect()


def test_vcf(spark, tmp_path):
    path = put(tmp_path, "a.vcf", "##fileformat=VCFv4.3\r\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\r\n1\t10\trs1\tA\tC,T\t.\tPASS\tDP=1;DB;X=a=b;DP=9\r\n\r\nX\t11\t.\tG\tA\t2.5\tq10\t.\tGT\t0/1")
    got = records.read_vcf(spark, path).orderBy("pos").collect()
    assert tuple(got[0]) == ("1", 10, "rs1", "A", "C,T", None, "PASS", {"DB": "true", "X": "a=b", "DP": "9"})
    assert tuple(got[1]) == ("X", 11, ".", "G", "A", 2.5, "q10", {})
    with pytest.raises(Exception, match="fewer than 8 fields"):
        records.read_vcf(spark, put(tmp_path, "b.vcf", "1\t2\t3")).collect()


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", "\n>one first > of all\nACGT\r\n AC\n\n>two\n>three x\nGG")
    got = {r.seq_id: (r.description, r.sequence) for r in records.read_fasta(spark, path).collect()}
    assert got == {"one": ("first > of all", "ACGTAC"), "two": ("", ""), "three": ("x", "GG")}
    many = "".join(f">s{i} d\n{'ACGT' * (i % 50)}\n" for i in range(3000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = records.read_fasta(spark, put(tmp_path, "b.fa", many))
        assert rows.rdd.getNumPartitions() > 3
        assert {(r.seq_id, len(r.sequence)) for r in rows.collect()} == {(f"s{i}", 4 * (i % 50)) for i in range(3000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(Exception, match="header without a name"):
        records.read_fasta(spark, put(tmp_path, "c.fa", ">a\nA\n> \nC\n")).collect()


LAS = """~Version
 VERS.   2.0 : version
 WRAP.   {wrap} : wrapped
~Well
# a remark
 STRT.M  100.0 : first: depth
 NULL.   -999.25 : none
 WELL.   A-1 :
~Curves
 DEPT.M  : depth
 GR.API  45 310 : gamma
~ASCII
{data}
"""


@pytest.mark.parametrize(("wrap", "data"), [("NO", "100.0 12.5\n100.5 -999.25"), ("YES", "100.0\n 12.5\n100.5\n-999.25")])
def test_las(spark, tmp_path, wrap, data):
    path = put(tmp_path, "a.las", LAS.format(wrap=wrap, data=data).replace("\n", "\r\n"))
    row = records.read_las(spark, path).first()
    assert row.curves == ["DEPT", "GR"] and row.data == [[100.0, 12.5], [100.5, None]]
    assert row.well["WELL"] == "A-1" and row.well["STRT"].startswith("100.0") and row.source_uri.endswith("a.las")
    assert records.read_las(spark, put(tmp_path, "b.las", LAS.format(wrap="NO", data=""))).first().data == []
    with pytest.raises(Exception, match="do not fill"):
        records.read_las(spark, put(tmp_path, "c.las", LAS.format(wrap="NO", data="1 2 3"))).collect()


def test_npy(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6.0).reshape(3, 2))
    assert sorted(map(tuple, records.read_npy(spark, f"{tmp_path}/a.npy", "x double, y double").collect())) == [(0.0, 1.0), (2.0, 3.0), (4.0, 5.0)]
    np.save(tmp_path / "b.npy", np.array([(1, 2.5)], dtype=[("k", "i8"), ("v", "f8")]))
    assert records.read_npy(spark, f"{tmp_path}/b.npy", "v double, k long").first().asDict() == {"v": 2.5, "k": 1}
    with pytest.raises(Exception, match="has no 3 columns"):
        records.read_npy(spark, f"{tmp_path}/a.npy", "a double, b double, c double").collect()


def test_hl7(spark, tmp_path):
    got = records.read_hl7(spark, put(tmp_path, "a.hl7", "MSH|^~\\&|lab\rPID|1|x\r")).orderBy("place").collect()
    assert [r.segment for r in got] == ["MSH", "PID"] and got[1].fields[-1] == "x"


@pytest.mark.parametrize("fmt", ["json", "xml", "text"])
def test_other_formats(spark, tmp_path, fmt):
    text = {"json": '[{"id": 1},\n {"id": 2}]', "xml": "<t><r><id>1</id></r><r><id>2</id></r></t>", "text": "1\n2"}[fmt]
    options = {"rowTag": "r"} if fmt == "xml" else {}
    got = files.read(spark, put(tmp_path, f"a.{fmt}", text), fmt, None if fmt == "text" else "id long", **options)
    assert sorted(int(r[0]) for r in got.collect()) == [1, 2]


def test_snapshot_changes(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t")
    one = spark.createDataFrame([(1, "EU"), (2, None)], "id int, region string")
    table.append(one, "2024-01-01")
    table.append(one.withColumns({"id": F.col("id") + 10, "more": F.lit("x")}), "2024-01-02")
    assert table.delete("region = 'EU' AND id < 5", "2024-01-03") == 3
    assert sorted(map(tuple, table.scan().collect())) == [(2, None, None), (11, "EU", "x"), (12, None, "x")]
    assert table.entry(3)["folders"][1] == table.entry(2)["folders"][1], "folders without such a row stay"
    assert table.compact("2024-01-04") == 4 and table.scan().count() == 3 and len(table.entry(4)["folders"]) == 1
    gone = table.vacuum(2)
    assert len(gone) == 1 and table.versions() == [3, 4] and table.scan(version=3).count() == 3
    assert table.append(one, "2024-01-05") == 5 and table.scan().count() == 5
    with pytest.raises(ValueError):
        table.vacuum(0)
