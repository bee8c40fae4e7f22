"""Readers and writers of life-science text formats, as plans over Spark's text and CSV sources (gzip included).

Line formats are one scan with a schema.  FASTA and FASTQ records span lines: they are read with a record separator, so a file
still splits where its compression allows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import collections as coll
from ..operators.store import settled

NULLS = ["", "NA", "na", "null", "."]


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited scan.  Types are inferred by column (long, double, boolean, else string); the null tokens are null."""
    raw = spark.read.csv(path, sep=sep, header=header, inferSchema=False)
    raw = raw.select(*[_null(F.trim(F.col(f"`{c}`"))).alias(c) for c in raw.columns])
    tests = {"bigint": "^-?[0-9]{1,18}$", "double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "boolean": "^(true|TRUE|false|FALSE)$"}
    fits = raw.agg(*[F.coalesce(F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").rlike(p)), F.lit(False)).alias(f"{k}:{i}") for i, c in enumerate(raw.columns) for k, p in tests.items()], *[F.count(f"`{c}`").alias(f"n:{i}") for i, c in enumerate(raw.columns)]).first()
    kinds = [next((k for k in tests if fits[f"n:{i}"] and fits[f"{k}:{i}"]), "string") for i in range(len(raw.columns))]
    return raw.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(raw.columns, kinds, strict=True)])


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t")


csv, tsv = read_csv, read_tsv


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header, nullValue="")


def write_tsv(df: DataFrame, path: str) -> None:
    write_csv(df, path, "\t")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


stream_lines = read_lines


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(df.columns[0]).cast("string")).write.mode(mode).text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text as a folder of one file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def append_text(df: DataFrame, path: str) -> None:
    write_lines(df, path, "append")


def count_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"))


def _null(c: Column) -> Column:
    return F.when(~c.isin(*NULLS), c)


def _fields(spark: SparkSession, path: str, names: list[tuple[str, str]], skip: str = r"^(#|track|browser|@|\s*$)") -> DataFrame:
    """Tab-separated lines without headers; missing fields are null."""
    parts = F.split("value", "\t", -1)
    cells = [F.nullif(F.get(parts, F.lit(i)), F.lit(".")).try_cast(kind).alias(name) if kind != "string" else F.get(parts, F.lit(i)).alias(name) for i, (name, kind) in enumerate(names)]
    return spark.read.text(path).filter(~F.col("value").rlike(skip)).select(*cells)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, [("chrom", "string"), ("start", "bigint"), ("end", "bigint"), ("name", "string"), ("score", "bigint"), ("strand", "string")])


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, [("chrom", "string"), ("start", "bigint"), ("end", "bigint"), ("value", "double")])


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, [("seqid", "string"), ("source", "string"), ("type", "string"), ("start", "bigint"), ("end", "bigint"), ("score", "double"), ("strand", "string"), ("phase", "string"), ("attributes", "string")], r"^(#|\s*$)")


read_gtf = read_gff


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt, qual ("." is 0), filter, info (a map)."""
    t = _fields(spark, path, [("chrom", "string"), ("pos", "bigint"), ("id", "string"), ("ref", "string"), ("alt", "string"), ("qual", "double"), ("filter", "string"), ("info", "string")], r"^(#|\s*$)")
    return t.withColumns({"qual": F.coalesce("qual", F.lit(0.0)), "info": coll.parse_info(F.coalesce("info", F.lit("")))})


def vcf_filter(spark: SparkSession, path: str, expr: str) -> DataFrame:
    """Variants for which `QUAL >= 30 && DP > 10` and the like hold; names beyond the columns are INFO keys."""
    cols = {"CHROM": "chrom", "POS": "pos", "ID": "id", "REF": "ref", "ALT": "alt", "QUAL": "qual", "FILTER": "filter"}

    def name(m: re.Match) -> str:
        word = m[0]
        if word.startswith(("'", '"')):
            return "'" + word[1:-1].replace("'", "''") + "'"
        return cols.get(word.upper()) or f"try_cast(try_element_at(info, '{word}') AS DOUBLE)"

    sql = re.sub(r"\"[^\"]*\"|'[^']*'|[A-Za-z_][A-Za-z_0-9.]*", name, expr.replace("&&", "\x01").replace("||", "\x02"))
    return read_vcf(spark, path).filter(sql.replace("\x01", " AND ").replace("\x02", " OR ").replace("==", "="))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, [("qname", "string"), ("flag", "bigint"), ("rname", "string"), ("pos", "bigint"), ("mapq", "bigint"), ("cigar", "string"), ("rnext", "string"), ("pnext", "bigint"), ("tlen", "bigint"), ("seq", "string"), ("qual", "string")], r"^(@[A-Z]{2}\t|\s*$)")


def sam_header(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^@[A-Z]{2}\t"))
    tags = F.slice(F.split("value", "\t"), F.lit(2), F.size(F.split("value", "\t")))
    return lines.select(F.substring("value", 2, 2).alias("type"), F.map_from_entries(F.transform(tags, lambda x: F.struct(F.substring(x, 1, 2).alias("k"), F.substring(x, 4, 2**31 - 1).alias("v")))).alias("tags"))


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, comment="#")


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """name, description, genes."""
    parts = F.split("value", "\t")
    return spark.read.text(path).filter("value <> ''").select(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).alias("description"), F.filter(F.slice(parts, F.lit(3), F.size(parts)), lambda g: g != "").alias("genes"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq, length; records may span lines."""
    rec = spark.read.text(path, lineSep="\n>").select(F.regexp_replace(F.col("value"), "^>", "").alias("r")).filter("r <> ''")
    head, body = F.regexp_replace(F.substring_index("r", "\n", 1), r"\r$", ""), F.when(F.contains("r", F.lit("\n")), F.regexp_replace("r", r"^[^\n]*\n", "")).otherwise("")
    seq = F.regexp_replace(body, r"\s", "")
    return rec.select(F.substring_index(head, " ", 1).alias("id"), F.when(F.contains(head, F.lit(" ")), F.regexp_replace(head, r"^\S* ", "")).otherwise("").alias("description"), seq.alias("seq"), F.char_length(seq).cast("long").alias("length"))


#: Blocks of FASTQ files whose line numbers are broadcast (about 100 bytes each); beyond it, a join by block.
BROADCAST_BLOCKS = 200_000


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """id, description, seq, length, quality of four-line records.  Files split where their compression allows: a first pass
    counts each block's lines and keeps the three at both of its ends; then records inside a block are put together where they
    lie, and the few that span blocks from those ends."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def ends(batches):
        import pyarrow as pa

        at, n, head, tail = None, 0, [], []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([head], pa.list_(pa.string())), pa.array([tail], pa.list_(pa.string()))], names=["file", "block", "n", "head", "tail"])
        for batch in batches:
            for value, *here in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != at:
                    if at is not None:
                        yield row()
                    at, n, head, tail = here, 0, [], []
                if n < 3:
                    head.append(value)
                tail = [*tail[-2:], value]
                n += 1
        if at is not None:
            yield row()

    blocks = settled(lines.mapInArrow(ends, "file string, block long, n long, head array<string>, tail array<string>"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    blocks = blocks.withColumn("before", before)
    starts = blocks.select("file", "block", "before")

    def inside(batches):
        import pyarrow as pa

        at, n, held, rows = None, 0, [], []

        def out():
            cols = [[r[k] for r in rows] for k in (0, 1, 3)]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["head", "seq", "quality"])

        for batch in batches:
            for value, file, block, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != at:
                    at, n, held = (file, block), first, []
                if n % 4 == 0:
                    held = [value]
                elif held:
                    held.append(value)
                    if len(held) == 4:
                        rows.append(held)
                        held = []
                n += 1
            if rows:
                yield out()

    known = F.broadcast(starts) if starts.count() <= BROADCAST_BLOCKS else starts
    placed = lines.join(known, ["file", "block"]).select("value", "file", "block", "before")
    whole = placed.mapInArrow(inside, "head string, seq string, quality string")
    edge = blocks.select("file", "block", "before", F.explode(F.array_union(F.transform("head", lambda x, i: F.struct((F.col("before") + i).alias("at"), x.alias("line"))), F.transform("tail", lambda x, i: F.struct((F.col("before") + F.col("n") - F.size("tail") + i).alias("at"), x.alias("line"))))).alias("e"))
    part = lambda k: F.max(F.when(F.col("e.at") % 4 == k, F.col("e.line")))
    across = edge.groupBy("file", F.expr("e.at div 4").alias("record")).agg(F.count_distinct("block").alias("blocks"), F.count(F.lit(1)).alias("lines"), part(0).alias("head"), part(1).alias("seq"), part(3).alias("quality"))
    records = whole.unionByName(across.filter("blocks > 1 AND lines = 4").select("head", "seq", "quality")).filter(F.col("head").startswith("@"))
    clean = records.select(*[F.regexp_replace(c, r"\r$", "").alias(c) for c in ("head", "seq", "quality")]).withColumn("head", F.substring("head", 2, 2**31 - 1))
    has = F.contains("head", F.lit(" "))
    return clean.select(F.substring_index("head", " ", 1).alias("id"), F.when(has, F.regexp_replace("head", r"^\S* ", "")).otherwise("").alias("description"), "seq", F.char_length("seq").cast("long").alias("length"), "quality")


fasta, fastq, bed, gff, vcf, sam, maf, bedgraph = read_fasta, read_fastq, read_bed, read_gff, read_vcf, read_sam, read_maf, read_bedgraph


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    head = F.concat(F.lit(">"), F.col("id"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise("") if "description" in df.columns else F.lit(""))
    body = F.rtrim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    df.select(F.concat_ws("\n", head, body).alias("value")).write.mode("overwrite").text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), "quality").alias("value")).write.mode("overwrite").text(path)


def write_bed(df: DataFrame, path: str) -> None:
    cols = [c for c in ("chrom", "start", "end", "name", "score", "strand") if c in df.columns]
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in cols]).alias("value")).write.mode("overwrite").text(path)


def write_gff(df: DataFrame, path: str) -> None:
    cols = ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in cols]).alias("value")).write.mode("overwrite").text(path)


def write_vcf(df: DataFrame, path: str) -> None:
    """Every part file begins with the header, so each is a VCF of its own."""
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";") if dict(df.dtypes).get("info", "").startswith("map") else F.col("info")
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter")], F.coalesce(F.nullif(info, F.lit("")), F.lit(".")))

    def headed(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    df.select(line.alias("value")).mapInArrow(headed, "value string").write.mode("overwrite").text(path)


# fixed values: what a data line of a format must match
_CHECKS = {"bed": r"^\S+\t\d+\t\d+(\t.*)?$", "vcf": r"^\S+\t\d+\t\S+\t[A-Za-z*.]+\t\S+\t\S+\t\S+\t\S+.*$", "gff": r"^[^\t]+\t[^\t]+\t[^\t]+\t\d+\t\d+\t\S+\t[+\-.?]\t[.012]\t.*$", "sam": r"^[^\t]+\t\d+\t[^\t]+\t\d+\t\d+\t.*$"}


def validate(spark: SparkSession, path: str) -> DataFrame:
    """valid, format, errors, lines_checked; the format by the file's ending."""
    kind = {"gff3": "gff", "gtf": "gff"}.get(path.removesuffix(".gz").rsplit(".", 1)[-1], path.removesuffix(".gz").rsplit(".", 1)[-1])
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^(#|@[A-Z]{2}\t|track|browser|\s*$)"))
    bad = F.count_if(~F.col("value").rlike(_CHECKS[kind]))
    return lines.agg((bad == 0).alias("valid"), F.lit(kind).alias("format"), bad.alias("errors"), F.count(F.lit(1)).alias("lines_checked"))


# ---------------------------------------------------------------- SQL tables


def sql(spark: SparkSession, query: str, params: dict | None = None) -> DataFrame:
    return spark.sql(query, args=params or {})


def sql_insert(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def sql_tables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name,) for t in spark.catalog.listTables()], "name string")


def sql_schema(spark: SparkSession, table: str) -> DataFrame:
    fields = spark.table(table).schema
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString(), not f.nullable) for i, f in enumerate(fields)], "cid int, name string, type string, notnull boolean")


def sql_close(spark: SparkSession) -> None:
    """Frees cached tables; a session has no handle to close."""
    spark.catalog.clearCache()


def is_db(x) -> bool:
    """Whether x can be asked by sql()."""
    return isinstance(x, SparkSession)
