"""Files as tables: FASTA, hit tables, pairwise-error matrices, structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of a hit table as searches write it.
HITS = "qseqid string, sseqid string, pident string, qcovhsp string, bitscore string"


def read_fasta(spark: SparkSession, path: str, stop: bool = False) -> DataFrame:
    """(id, seq) of plain or gzipped FASTA, split at ``>`` on line starts; ``stop`` strips one trailing ``*``."""
    records = spark.read.text(path, lineSep="\n>").where("length(trim(value)) > 0")
    head = F.regexp_extract("value", r"^>?([^\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s+", "")
    out = records.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("id"), seq.alias("seq"))
    return out.withColumn("seq", F.regexp_replace("seq", r"\*$", "")) if stop else out


def count_fasta(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.col("value").startswith(">")).count()


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.format_string(">%s\n%s", "id", "seq").alias("value")).write.text(path)


def read_hits(spark: SparkSession, path: str, schema: str = HITS) -> DataFrame:
    """Headerless tab-separated hits; blank lines, comments and rows of another width go."""
    width = len(schema.split(","))
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where("length(trim(value)) > 0 AND NOT startswith(value, '#')").where(F.size(parts) == width)
    return rows.select(*(parts[i].alias(c.split()[0]) for i, c in enumerate(schema.split(","))))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True)


def pae_cells(texts: DataFrame, step: int = 1) -> DataFrame:
    """(ref_id, i, j, pae) of JSON texts (ref_id, value) in the matrix or the pairs layout, every ``step``-th row and column."""
    ddl = "array<struct<predicted_aligned_error: array<array<double>>, residue1: array<int>, distance: array<double>>>"
    one = texts.select("ref_id", F.from_json("value", ddl)[0].alias("x"))
    rows = one.where("x.predicted_aligned_error IS NOT NULL").select("ref_id", F.posexplode("x.predicted_aligned_error").alias("i", "row"))
    cells = rows.where(f"i % {step} = 0").select("ref_id", "i", F.posexplode("row").alias("j", "pae"))
    flat = one.where("x.distance IS NOT NULL").select("ref_id", F.expr("CAST(sqrt(size(x.distance)) AS INT)").alias("n"), F.posexplode("x.distance").alias("at", "pae"))
    flat = flat.selectExpr("ref_id", "at DIV n AS i", "at % n AS j", "pae").where(f"i % {step} = 0")
    return cells.unionByName(flat).where(f"j % {step} = 0").selectExpr("ref_id", "CAST(i DIV {0} AS INT) AS i".format(step), "CAST(j DIV {0} AS INT) AS j".format(step), "pae")


def pdb_atoms(lines: DataFrame) -> DataFrame:
    """Fixed-width ATOM rows of (ref_id, value) lines, with the B-factor as ``plddt``."""
    part = lambda s, n: F.trim(F.substring("value", s, n))
    rows = lines.where(F.col("value").startswith("ATOM"))
    xyz = (part(s, 8).try_cast("double").alias(c) for c, s in (("x", 31), ("y", 39), ("z", 47)))
    return rows.select("ref_id", part(13, 4).alias("atom"), part(18, 3).alias("resname"), part(22, 1).alias("chain"), part(23, 4).try_cast("int").alias("res"), *xyz, part(61, 6).try_cast("double").alias("plddt"))


def valid_pdb(content: str) -> Column:
    """Whether a text begins like a structure file."""
    return F.rtrim(F.substring(content, 1, 6)).isin("HEADER", "REMARK", "ATOM", "MODEL")


def first_existing(df: DataFrame, *names: str) -> str:
    """The first of several column names that a table has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {', '.join(names)} among {', '.join(df.columns)}")


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first of several Parquet tables that exists."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return spark.read.parquet(path)
    raise FileNotFoundError(", ".join(paths))


def count_fasta_or_zero(spark: SparkSession, path: str) -> int:
    """As ``count_fasta``; 0 where the file can't be read."""
    from pyspark.errors import PySparkException

    try:
        return count_fasta(spark, path)
    except PySparkException:
        return 0


def valid_hits(spark: SparkSession, path: str, columns: int = 8) -> bool:
    """Whether a hits file has a first line, with that many tab-separated fields."""
    first = spark.read.text(path).limit(1).collect()
    return bool(first) and len(first[0].value.split("\t")) == columns


def discover(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Paths in a folder that end in ``suffix``, in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(p, f"*{suffix}")) or []
    return sorted(f.getPath().toString() for f in found)


def filter_hits(rows: DataFrame, pident: float = 0.0, qcov: float = 0.0, db: str = "") -> DataFrame:
    """Hits with their numbers cast where they are some, those within the bounds, labelled with a database."""
    from ..operators.hits import filter_tolerant

    numbers = {c: F.col(c).try_cast("double") for c in ("pident", "qcovhsp", "bitscore", "evalue", "length") if c in rows.columns}
    return filter_tolerant(rows, pident=pident, qcovhsp=qcov).withColumns(numbers).withColumn("db", F.lit(db))


def pae_arrays(spark: SparkSession, path: str, step: int = 1) -> DataFrame:
    """(ref_id, i, j, pae) of square matrices in .npy files, the file's stem as id, every ``step``-th row and column; a file is read in one task."""
    import io

    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("ref_id", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("pae", pa.float64())])

    def cells(batches):
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                m = np.load(io.BytesIO(content), allow_pickle=False)[::step, ::step].astype(float)
                i, j = np.indices(m.shape, np.int32)
                stem = name.rsplit("/", 1)[-1].removesuffix(".npy")
                yield pa.RecordBatch.from_arrays([pa.array([stem] * m.size), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(m.ravel())], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    return files.select("path", "content").mapInArrow(cells, "ref_id string, i int, j int, pae double")


def read_pdb(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, value): lines of the first model of structure files, plain or gzipped, in the order of the file."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.pdb)?(?:\.gz)?$", 1).alias("ref_id"), "value")
    first = F.get(F.split("value", r"(?m)^ENDMDL"), F.lit(0))
    return text.select("ref_id", F.posexplode(F.split(first, r"\r?\n")).alias("line", "value")).where("value <> ''").select("ref_id", "value")


def polymer(atoms: DataFrame, chain: str = "A") -> DataFrame:
    """Atoms of one chain's residues."""
    return atoms.where((F.col("chain") == chain) & F.col("res").isNotNull())


def backbone(atoms: DataFrame) -> DataFrame:
    """(ref_id, chain, res, resname, atoms): backbone atoms as a map from name to point, for residues that have a CA, all chains."""
    rows = atoms.where(F.col("atom").isin("N", "CA", "C", "O", "CB"))
    point = F.struct("atom", F.struct("x", "y", "z"))
    out = rows.dropDuplicates(["ref_id", "chain", "res", "atom"]).groupBy("ref_id", "chain", "res", "resname").agg(F.map_from_entries(F.collect_list(point)).alias("atoms"))
    return out.where(F.map_contains_key("atoms", F.lit("CA")))


def pdb_lines(points: DataFrame) -> DataFrame:
    """(ref_id, pos, value): fixed-width CA records of points (ref_id, pos, resname, x, y, z, plddt)."""
    form = "ATOM  %5d  CA  %3s A%4d    %8.3f%8.3f%8.3f  1.00%6.2f           C"
    number = (F.col("pos") + 1).cast("int")
    return points.select("ref_id", "pos", F.format_string(form, number, "resname", number, "x", "y", "z", "plddt").alias("value"))


def write_pdb(points: DataFrame, path: str) -> None:
    """A structure file for each reference: its records in order, and an end line; a structure is one row of text."""
    lines = pdb_lines(points).groupBy("ref_id").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("rows"))
    text = F.concat(F.array_join(F.transform("rows", lambda r: r["value"]), "\n"), F.lit("\nEND"))
    lines.select(F.col("ref_id").cast("string").alias("ref_id"), text.alias("value")).write.partitionBy("ref_id").text(path)


def append_rows(df: DataFrame, path: str, key: str) -> None:
    """Rows whose key the table at ``path`` lacks, appended; run again, it adds nothing."""
    try:
        have = df.sparkSession.read.parquet(path).select(key)
    except Exception as e:  # a table that isn't there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        df = df.join(have, key, "left_anti")
    df.write.mode("append").parquet(path)


def create_index_table(df: DataFrame, name: str, key: str, buckets: int = 16) -> None:
    """A table in the warehouse, bucketed and sorted by its key: what an index is for."""
    df.write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)


def read_pae(spark: SparkSession, path: str, step: int = 1) -> DataFrame:
    """(ref_id, i, j, pae) of all JSON error matrices under a path, the file's stem as id."""
    texts = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.json)?$", 1).alias("ref_id"), "value")
    return pae_cells(texts, step)


# fixed values: the 37 heavy atoms of residues in the order in which structure models write them
ATOM37 = (
    "N", "CA", "C", "CB", "O", "CG", "CG1", "CG2", "OG", "OG1", "SG", "CD", "CD1", "CD2", "ND1", "ND2", "OD1", "OD2", "SD",
    "CE", "CE1", "CE2", "CE3", "NE", "NE1", "NE2", "OE1", "OE2", "CH2", "NH1", "NH2", "OH", "CZ", "CZ2", "CZ3", "NZ", "OXT",
)


def atom37_rows(structures: DataFrame) -> DataFrame:
    """Atoms of structures (ref_id, sequence, mask, positions, confidence, residue_index): a row for each atom whose mask holds.

    Mask and positions are arrays over residues of arrays over ``ATOM37``; a
    confidence of at most 1.01 anywhere is a fraction, and becomes percent.
    """
    from ..functions.alphabet import three_letters

    scale = F.when(F.array_max("confidence") <= 1.01, 100.0).otherwise(1.0)
    each = F.arrays_zip(three_letters(F.col("sequence")).alias("resname"), F.col("mask"), F.col("positions"), F.col("confidence"), F.col("residue_index"))
    rows = structures.withColumn("scale", scale).select("ref_id", "scale", F.explode(each).alias("r"))
    rows = rows.select("ref_id", "scale", "r.*").select("ref_id", "scale", "resname", "confidence", "residue_index", F.posexplode(F.arrays_zip("mask", "positions")).alias("k", "a"))
    name = F.element_at(F.array(*map(F.lit, ATOM37)), F.col("k") + 1)
    xyz = (F.col("a.positions")[i].cast("double").alias(c) for i, c in enumerate("xyz"))
    return rows.where("a.mask").select("ref_id", name.alias("atom"), "resname", F.lit("A").alias("chain"), F.col("residue_index").cast("int").alias("res"), *xyz, (F.col("confidence") * F.col("scale")).alias("plddt"))


def decode_blobs(blobs: DataFrame) -> DataFrame:
    """(ref_id, kind, value) of binary structures (ref_id, content): structure text as it is (pdb), zstd or gzip frames and brotli inflated, msgpack as JSON.

    brotli and msgpack are read where their packages are installed, else such a blob's kind is ``unreadable``.
    ``broken`` is what a package or the frame's own format can't read: cut frames, other bytes, text that isn't UTF-8.
    """
    import gzip
    import json
    import zlib

    import pyarrow as pa
    import zstandard

    schema = pa.schema([("ref_id", pa.string()), ("kind", pa.string()), ("value", pa.string())])

    def plain(x):
        return x.decode() if isinstance(x, bytes) else list(x)

    def decode(raw: bytes) -> tuple[str, str | None]:
        try:
            if raw[:4] == b"\x28\xb5\x2f\xfd":
                inflater = zstandard.ZstdDecompressor().decompressobj()
                raw = inflater.decompress(raw)
                if not inflater.eof:
                    return "broken", None
            elif raw[:2] == b"\x1f\x8b":
                raw = gzip.decompress(raw)
            if raw[:6].rstrip() in (b"HEADER", b"REMARK", b"ATOM", b"MODEL"):
                return "pdb", raw.decode()
            if raw[:1] in (b"{", b"["):
                return "json", raw.decode()
        except (zstandard.ZstdError, zlib.error, OSError, EOFError, UnicodeDecodeError):
            return "broken", None
        try:
            import brotli
            import msgpack
        except ImportError:
            return "unreadable", None
        try:
            return "json", json.dumps(msgpack.unpackb(brotli.decompress(raw)), default=plain)
        except (brotli.error, msgpack.UnpackException, ValueError, TypeError):
            return "broken", None

    def run(batches):
        for batch in batches:
            rows = [(i, *decode(c)) if c is not None else (i, "missing", None) for i, c in zip(batch["ref_id"].to_pylist(), batch["content"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], schema=schema)

    return blobs.select(F.col("ref_id").cast("string"), "content").mapInArrow(run, "ref_id string, kind string, value string")


STRUCTURE = "struct<sequence: string, atom37_mask: array<array<boolean>>, atom37_positions: array<array<array<double>>>, confidence: array<double>, residue_index: array<int>>"


def structures_of(decoded: DataFrame) -> DataFrame:
    """What ``atom37_rows`` takes, of JSON structures; residues without an index are numbered from 1."""
    rows = decoded.where("kind = 'json'").select("ref_id", F.from_json("value", STRUCTURE).alias("x")).where("x.sequence IS NOT NULL")
    index = F.coalesce("x.residue_index", F.sequence(F.lit(1), F.length("x.sequence")))
    return rows.select("ref_id", "x.sequence", F.col("x.atom37_mask").alias("mask"), F.col("x.atom37_positions").alias("positions"), "x.confidence", index.alias("residue_index"))


def read_pae_rows(spark: SparkSession, path: str, step: int = 1) -> DataFrame:
    """``read_pae`` for large matrices: each row of a matrix is one record, so no task holds a matrix, and of each ``step``-th row only each ``step``-th number becomes a row.

    Records end at ``]``; a file's records are numbered in its order, over its splits.
    The flat layout has one list for all distances, which is one record.
    """
    rows = spark.read.text(path, lineSep="]").select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.json)?$", 1).alias("ref_id"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = rows.where(F.col("value").contains("[")).select("ref_id", "block", "at", F.regexp_extract("value", r'"(\w+)"\s*:\s*\[', 1).alias("name"), F.regexp_extract("value", r"\[([^\[]*)$", 1).alias("numbers"))
    numbers = F.split(F.col("numbers"), r"\s*,\s*")
    flat = rows.where("name = 'distance'").select("ref_id", numbers.alias("v")).withColumn("n", F.round(F.sqrt(F.size("v"))).cast("int"))
    every = F.expr(f"transform(sequence(0, (n - 1) DIV {step}), i -> struct(i, transform(sequence(0, (n - 1) DIV {step}), j -> struct(j, v[i * {step} * n + j * {step}] AS pae)) AS cells))")
    flat = flat.where("n > 0").select("ref_id", F.inline(every)).select("ref_id", "i", F.inline("cells"))
    matrix = rows.where("name IN ('', 'predicted_aligned_error') AND length(numbers) > 0")
    place = F.row_number().over(Window.partitionBy("ref_id").orderBy("block", "at")) - 1
    # rows of lists are numbered before their numbers are read; a matrix's rows are bounded by its length
    matrix = matrix.withColumn("i", place).where(f"i % {step} = 0").select("ref_id", (F.expr(f"i DIV {step}")).cast("int").alias("i"), numbers.alias("v"))
    cells = matrix.select("ref_id", "i", F.inline(F.expr(f"transform(sequence(0, (size(v) - 1) DIV {step}), j -> struct(j, v[j * {step}] AS pae))")))
    out = cells.unionByName(flat)
    return out.select("ref_id", "i", "j", F.trim("pae").cast("double").alias("pae"))
