"""File helpers over Hadoop's file systems, so that they work on any store that Spark reads."""

from __future__ import annotations

import posixpath
import struct
import subprocess
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def file_exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def file_size(spark: SparkSession, path: str) -> int:
    fs, p, _ = _fs(spark, path)
    return fs.getContentSummary(p).getLength()


def list_dir(spark: SparkSession, path: str) -> DataFrame:
    """name, size, directory of what a folder holds."""
    fs, p, _ = _fs(spark, path)
    rows = [(s.getPath().getName(), s.getLen(), s.isDirectory()) for s in fs.listStatus(p)]
    return spark.createDataFrame(sorted(rows), "name string, size long, directory boolean")


def glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p, _ = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


def mkdir(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str, recursive: bool = False) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.delete(p, recursive)


def rename_file(spark: SparkSession, old: str, new: str) -> bool:
    fs, p, jvm = _fs(spark, old)
    return fs.rename(p, jvm.org.apache.hadoop.fs.Path(new))


def copy_file(spark: SparkSession, old: str, new: str) -> bool:
    fs, p, jvm = _fs(spark, old)
    to = jvm.org.apache.hadoop.fs.Path(new)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to.getFileSystem(conf), to, False, conf)


def verify_checksum(spark: SparkSession, path: str, digest: str, kind: str = "sha256") -> bool:
    """Compares a file's digest, worked out where the file is read."""
    from pyspark.sql import functions as F

    fn = {"md5": F.md5, "sha1": F.sha1, "sha256": lambda c: F.sha2(c, 256), "sha512": lambda c: F.sha2(c, 512)}[kind]
    return spark.read.format("binaryFile").load(path).select(fn("content")).first()[0] == digest.lower()


def remove_dir(spark: SparkSession, path: str, recursive: bool = False) -> bool:
    """Deletes a folder; one that holds something only if recursive."""
    if not is_dir(spark, path):
        raise ValueError(f"no folder {path}")
    return remove(spark, path, recursive)


def abs_path(spark: SparkSession, path: str) -> str:
    """The path with its store, as Spark reads it."""
    fs, p, _ = _fs(spark, path)
    return fs.makeQualified(p).toString()


def _fresh(spark: SparkSession, kind: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def temp_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    path = _fresh(spark, "folder")
    mkdir(spark, path)
    return path


def temp_file(spark: SparkSession) -> str:
    """A new empty file in the shared folder."""
    path = _fresh(spark, "file")
    fs, p, _ = _fs(spark, path)
    fs.create(p).close()
    return path


def _copied(spark: SparkSession, source: str, target: str, wrap) -> int:
    """Copies bytes between stores through streams of the JVM; returns the size of the target."""
    fs, p, jvm = _fs(spark, source)
    to, q, _ = _fs(spark, target)
    read, write = wrap(jvm, fs.open(p), to.create(q))
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, write, 1 << 16, True)
    return file_size(spark, target)


def gzip(spark: SparkSession, source: str, target: str) -> int:
    return _copied(spark, source, target, lambda jvm, i, o: (i, jvm.java.util.zip.GZIPOutputStream(o)))


def gunzip(spark: SparkSession, source: str, target: str) -> int:
    """Reads all members of a gzip file, so blocked files as well."""
    return _copied(spark, source, target, lambda jvm, i, o: (jvm.java.util.zip.GZIPInputStream(i), o))


#: Bytes of text in a block of a blocked gzip file, and its fixed last block.
BLOCK = 0xFF00
BLOCK_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def bgzip(source: str, target: str) -> int:
    """Writes a local file as blocked gzip: members of bounded size, each with its length in an extra field."""
    with open(source, "rb") as f, open(target, "wb") as out:
        while block := f.read(BLOCK):
            deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = deflate.compress(block) + deflate.flush()
            out.write(struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25))
            out.write(body + struct.pack("<II", zlib.crc32(block), len(block)))
        out.write(BLOCK_END)
        return out.tell()


def shell(command: str, timeout: float | None = None) -> dict:
    """Runs a command on the driver: its output, errors and exit code."""
    done = subprocess.run(command, shell=True, capture_output=True, text=True, timeout=timeout, check=False)
    return {"stdout": done.stdout, "stderr": done.stderr, "exit_code": done.returncode}


basename, dirname, path_join = posixpath.basename, posixpath.dirname, posixpath.join


def extension(path: str) -> str:
    return posixpath.splitext(path)[1].lstrip(".")
