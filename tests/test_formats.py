"""Readers and writers: each format back and forth, and its edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from lociframe.functions import stats as st
from lociframe.operators import graph as gr
from lociframe.operators import matrix as mx
from lociframe.operators import tables as tb
from lociframe.sources import formats as fm
from lociframe.streaming import batches as sb


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_csv_types_and_nulls(spark, tmp_path):
    p = put(tmp_path, "a.csv", "name,age,score,ok,none\nann,3,1.5,true,NA\nbob,NA,2,false,.\n")
    df = fm.read_csv(spark, p)
    assert df.dtypes == [("name", "string"), ("age", "bigint"), ("score", "double"), ("ok", "boolean"), ("none", "string")]
    assert [tuple(r) for r in df.orderBy("name").collect()] == [("ann", 3, 1.5, True, None), ("bob", None, 2.0, False, None)]


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">s1 first one\nACGT\nAC\n>s2\n\n>s3 x\nTT\n")
    rows = {r.id: r for r in fm.read_fasta(spark, p).collect()}
    assert rows["s1"].seq == "ACGTAC" and rows["s1"].description == "first one" and rows["s1"].length == 6
    assert rows["s2"].seq == "" and rows["s3"].seq == "TT"
    out = str(tmp_path / "out.fa")
    fm.write_fasta(fm.read_fasta(spark, p), out, width=4)
    assert {r.id: r.seq for r in fm.read_fasta(spark, out).collect()} == {"s1": "ACGTAC", "s2": "", "s3": "TT"}


def test_fastq(spark, tmp_path):
    p = put(tmp_path, "a.fq", "@r1 d\nACGT\n+\n@III\n@r2\nAC\n+\n!!\n")
    rows = {r.id: r for r in fm.read_fastq(spark, p).collect()}
    assert rows["r1"].quality == "@III" and rows["r1"].description == "d" and rows["r2"].length == 2
    out = str(tmp_path / "out.fq")
    fm.write_fastq(fm.read_fastq(spark, p).coalesce(1), out)
    assert fm.read_fastq(spark, out).count() == 2


def test_bed_vcf_gff_sam_gmt(spark, tmp_path):
    bed = put(tmp_path, "a.bed", "track x\nchr1\t0\t10\tn\t5\t+\nchr2\t5\t9\n")
    assert [(r.chrom, r.start, r.end, r.score) for r in fm.read_bed(spark, bed).orderBy("chrom").collect()] == [("chr1", 0, 10, 5), ("chr2", 5, 9, None)]
    vcf = put(tmp_path, "a.vcf", "##x\n#CHROM\tPOS\nchr1\t7\t.\tA\tG\t30\tPASS\tDP=12;DB\nchr1\t9\t.\tA\tAT\t.\tPASS\t.\n")
    t = fm.read_vcf(spark, vcf).orderBy("pos").collect()
    assert t[0]["info"] == {"DP": "12", "DB": "true"} and t[1]["qual"] == 0.0 and t[1]["info"] == {}
    assert [r.pos for r in fm.vcf_filter(spark, vcf, 'QUAL >= 30 && DP > 10').collect()] == [7]
    fm.write_vcf(fm.read_vcf(spark, vcf).coalesce(1), str(tmp_path / "o.vcf"))
    assert fm.read_vcf(spark, str(tmp_path / "o.vcf")).count() == 2
    gff = put(tmp_path, "a.gff", "##gff-version 3\nc\ts\tgene\t1\t9\t.\t+\t.\tID=g1\n")
    assert fm.read_gff(spark, gff).first()["score"] is None
    sam = put(tmp_path, "a.sam", "@HD\tVN:1.6\nr1\t99\tchr1\t7\t60\t4M\t=\t9\t6\tACGT\tIIII\n")
    assert fm.read_sam(spark, sam).first()["flag"] == 99 and fm.sam_header(spark, sam).first()["tags"] == {"VN": "1.6"}
    gmt = put(tmp_path, "a.gmt", "set1\td\tA\tB\n")
    assert fm.read_gmt(spark, gmt).first()["genes"] == ["A", "B"]
    bg = put(tmp_path, "a.bedgraph", "track\nchr1\t0\t5\t1.5\n")
    assert fm.read_bedgraph(spark, bg).first()["value"] == 1.5
    assert fm.validate(spark, bed).first()["valid"] and not fm.validate(spark, put(tmp_path, "b.bed", "chr1\tx\ty\n")).first()["valid"]


def test_statistics():
    assert math.isclose(st.t_two_sided(2.0, 10), 0.07338803, rel_tol=1e-6)
    assert math.isclose(st.f_tail(3.0, 2, 20), 0.07254, rel_tol=1e-3)
    assert math.isclose(st.chi_tail(3.84145882, 1), 0.05, rel_tol=1e-6)
    assert math.isclose(st.fisher_exact(3, 1, 1, 3)["p_value"], 0.48571428, rel_tol=1e-6)


def test_small_matrices(spark):
    m = mx.matrix(spark, [[2.0, 1.0], [1.0, 3.0]])
    assert math.isclose(mx.determinant(m), 5.0)
    assert mx.to_numpy(mx.dot(m, mx.inverse(m))).round(9).tolist() == [[1.0, 0.0], [0.0, 1.0]]
    assert len(mx.eigenvalues(m)) == 2 and len(mx.svd(m)["d"]) == 2


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "from long, to long")
    g = gr.graph(nodes, edges)
    assert {r.id: r.component for r in g.connected_components().collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6}
    assert g.shortest_path(0, 3) == [0, 1, 2, 3] and g.shortest_path(0, 5) is None
    assert g.has_edge(1, 0) and not g.has_edge(0, 4)
    assert g.add_edge(6, 0).degree(0).first()["degree"] == 2
    assert g.remove_edge(0, 1).edge_count().first()["edges"] == 3


def test_event_time_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_seconds(id * 30) AS ts, id % 2 AS k FROM range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    live = sb.read_stream(spark, str(tmp_path / "in"), rows.schema)
    sb.drain(sb.tumbling(live, "ts", "10 minutes", ["k"], late="1 minute", n=F.count(F.lit(1))), str(tmp_path / "out"), str(tmp_path / "ck"))
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() > 0 and set(r.n for r in done.collect()) == {10}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, v double")
    assert tb.row_number(empty, "k").count() == 0
    assert tb.cumsum(empty, "v", "k").count() == 0
    assert tb.lag(empty, "v", "k").count() == 0
    assert tb.inner_join(empty, empty, "k").count() == 0


def test_long_path(spark):
    nodes = spark.range(108)
    edges = spark.range(106).select(F.col("id").alias("from"), (F.col("id") + 1).alias("to"))
    g = gr.graph(nodes, edges)
    assert g.shortest_path(0, 105) == list(range(106))
    assert g.shortest_path(0, 3, max_steps=3) == [0, 1, 2, 3]
    with pytest.raises(RuntimeError):
        g.shortest_path(0, 4, max_steps=3)
