"""File helpers, BAM, reads and control helpers."""

import gzip
import hashlib
import struct

from lociframe.operators import alignment as al
from lociframe.plans import control as ct
from lociframe.sources import bam, files


def test_files(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("abc")
    assert files.file_exists(spark, str(p)) and files.is_file(spark, str(p)) and files.is_dir(spark, str(tmp_path))
    assert files.file_size(spark, str(p)) == 3 and files.extension("x/y.vcf.gz") == "gz"
    assert files.verify_checksum(spark, str(p), hashlib.sha256(b"abc").hexdigest())
    files.copy_file(spark, str(p), str(tmp_path / "b.txt"))
    assert [f.rsplit("/", 1)[1] for f in files.glob(spark, f"{tmp_path}/*.txt")] == ["a.txt", "b.txt"]
    files.rename_file(spark, str(tmp_path / "b.txt"), str(tmp_path / "c.txt"))
    assert files.remove(spark, str(tmp_path / "c.txt")) and not files.file_exists(spark, str(tmp_path / "c.txt"))
    assert files.list_dir(spark, str(tmp_path)).filter("name = 'a.txt'").first()["size"] == 3


def test_bam(spark, tmp_path):
    name, seq = b"r1\0", bytes([0x12, 0x48])
    rec = struct.pack("<iiBBHHHiiii", 0, 6, len(name), 60, 0, 1, 99, 4, 0, 8, 6) + name + struct.pack("<I", 4 << 4) + seq + bytes([40] * 4)
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 100)
    (tmp_path / "a.bam").write_bytes(gzip.compress(head) + gzip.compress(struct.pack("<i", len(rec)) + rec))
    r = bam.read_bam(spark, str(tmp_path / "a.bam")).collect()
    assert [tuple(x) for x in r] == [("r1", 99, "chr1", 7, 60, "4M", "=", 9, 6, "ACGT", "IIII")]


def test_align():
    a = al.align_pair("ACGTACGT", "ACGACGT")
    assert a["aligned1"] == "ACGTACGT" and a["aligned2"] == "ACG-ACGT" and a["score"] == 5.0 and a["gaps"] == 1
    assert al.align_pair("TTACGTTT", "ACG", "local")["aligned1"] == "ACG"
    assert al.align_pair("", "AC")["aligned1"] == "--"


def test_control(spark, tmp_path):
    assert ct.try_call(lambda: 1 / 0)["ok"] is False and ct.par_map([1, 2], lambda x: x + 1) == [2, 3]
    df = ct.with_provenance(spark.range(3), source="a")
    assert ct.provenance(df)["source"] == "a"
    assert ct.checkpoint(df, str(tmp_path), "x").count() == 3 and "Range" in ct.pipeline_steps(df)[0]
    assert ct.sparkline([0, 1]) == "▁█" and ct.to_markdown(spark.range(1)).endswith("| 0 |")
