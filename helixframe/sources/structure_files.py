"""Structure files with all atoms: template copies, their text, and one file a structure.

Files are written by a data source: a task writes its structures into a folder of its
own under a temporary name; once all tasks are done the driver renames the folders,
one a task, however many files they hold.  The path is one that all workers mount.
"""

from __future__ import annotations

import glob
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.alphabet import THREE
from .readers import ATOM37


def copied_templates(atoms: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Atoms of the templates under the queries' letters, and a status for each of ``rows`` (name, ref_id, q: the gapped query over the template).

    ``atoms`` are those of one chain (ref_id, atom, resname, res, x, y, z, plddt).  The query
    begins where its leading gaps end; residues outside it go, those inside keep their
    atoms and numbers and take the query's names (a letter without a name keeps the template's).  Statuses:
    ``no_pdb``, ``too_short`` where the template ends before the query, ``gapped`` where
    the query has a gap inside, ``ok``.
    """
    place = F.dense_rank().over(Window.partitionBy("ref_id").orderBy("res")) - 1
    numbered = atoms.withColumn("place", place)
    sizes = numbered.groupBy("ref_id").agg((F.max("place") + 1).alias("size"))
    span = F.regexp_replace("q", "^-+|-+$", "")
    wanted = rows.select("name", "ref_id", span.alias("seq"), (F.length("q") - F.length(F.regexp_replace("q", "^-+", ""))).alias("lead"))
    judged = wanted.join(sizes, "ref_id", "left")
    status = F.when(F.col("size").isNull(), "no_pdb").when(F.col("seq").contains("-"), "gapped").when(F.col("lead") + F.length("seq") > F.col("size"), "too_short").otherwise("ok")
    judged = judged.withColumn("status", status)
    names = F.create_map(*(F.lit(x) for pair in THREE.items() for x in pair))
    out = numbered.join(judged.where("status = 'ok'").select("name", "ref_id", "seq", "lead"), "ref_id").where("place >= lead AND place < lead + length(seq)")
    letter = F.expr("substring(seq, CAST(place - lead AS INT) + 1, 1)")
    out = out.withColumn("resname", F.coalesce(names[letter], F.col("resname"))).drop("place", "seq", "lead")
    return out, judged.select("name", "ref_id", "status")


def first_built(built: DataFrame, hits: DataFrame) -> DataFrame:
    """(query, name): of each query the first of its hits (query, name, rank), the lowest rank first, whose copy (name, status) is ok; null where none is."""
    best = hits.join(built.where("status = 'ok'").select("name"), "name", "left_semi").groupBy("query").agg(F.min_by("name", F.struct("rank", "name")).alias("name"))
    return hits.select("query").distinct().join(best, "query", "left")


def structure_texts(atoms: DataFrame) -> DataFrame:
    """(name, text): ATOM records of atoms (name, atom, resname, res, x, y, z, plddt) in the order of residues and of atoms in them, an end of chain, an end."""
    rank = F.array_position(F.array(*map(F.lit, ATOM37)), F.col("atom"))
    order = Window.partitionBy("name").orderBy("res", F.when(rank == 0, 99).otherwise(rank), "atom")
    rows = atoms.withColumn("serial", F.row_number().over(order))
    title = F.when(F.length("atom") < 4, F.concat(F.lit(" "), F.rpad("atom", 3, " "))).otherwise(F.col("atom"))
    element = F.substring(F.regexp_replace("atom", "^[0-9]+", ""), 1, 1)
    form = "ATOM  %5d %s %3s A%4d    %8.3f%8.3f%8.3f  1.00%6.2f          %2s"
    line = F.format_string(form, "serial", title, "resname", F.col("res").cast("int"), "x", "y", "z", F.coalesce("plddt", F.lit(0.0)), element)
    last = F.format_string("TER   %5d      %3s A%4d", F.col("last.serial") + 1, F.col("last.resname"), F.col("last.res").cast("int"))
    lines = rows.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("serial", line.alias("line")))).alias("rows"), F.max(F.struct("serial", "resname", "res")).alias("last"))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return lines.select("name", F.concat(body, F.lit("\n"), last, F.lit("\nEND\n")).alias("text"))


@dataclass
class _Folder(WriterCommitMessage):
    temporary: str
    final: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, suffix: str):
        self.path, self.overwrite, self.suffix, self.job = path, overwrite, suffix, uuid.uuid4().hex
        os.makedirs(path, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        pid, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        folder, made = os.path.join(self.path, f".{self.job}-{pid}-{attempt}"), False
        for batch in iterator:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if not made:
                    os.makedirs(folder)
                    made = True
                with open(os.path.join(folder, re.sub(r"[^\w.:-]", "_", name) + self.suffix), "x", encoding="utf-8") as f:
                    f.write(text or "")
        return _Folder(folder if made else "", os.path.join(self.path, f"part-{self.job[:8]}-{pid:05d}"))

    def commit(self, messages) -> None:
        if self.overwrite:
            for old in glob.glob(os.path.join(self.path, "part-*")):
                shutil.rmtree(old)
        for m in messages:
            if m and m.temporary:
                os.rename(m.temporary, m.final)
        self._sweep()

    def abort(self, messages) -> None:
        self._sweep()

    def _sweep(self) -> None:
        """What this job's other attempts left."""
        for left in glob.glob(os.path.join(self.path, f".{self.job}-*")):
            shutil.rmtree(left)


class TextFiles(DataSource):
    """``df.write.format("text_files")``: rows (name, text) as a file each, in a folder a task; option ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"].removeprefix("file://"), overwrite, self.options.get("suffix", ""))


def write_structures(atoms: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each structure of ``atoms``, as of ``structure_texts``; two names that differ only in characters no file takes are an error."""
    atoms.sparkSession.dataSource.register(TextFiles)
    structure_texts(atoms).select("name", "text").write.format("text_files").mode(mode).option("suffix", ".pdb").save(path)
