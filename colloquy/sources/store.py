"""Raw files, JSON lines, and the versioned graph store. Every path goes through Spark's file systems."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators import evidence, graph
from . import digests

_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RAW = {
    "subjects": _schema(InterventionId=_LONG, SubjectId=_LONG, ParentSubjectId=_LONG, SubjectName=_TEXT, SubjectLevel=_INT, SubjectType=_TEXT),
    "question_metadata": _schema(QuestionId_DQ=_LONG, InterventionId=_LONG, MetaDataId=_LONG, Text=_TEXT, Sequence=_INT, MetaDataTagId=_INT, Label=_TEXT),
    "dialogues": _schema(InterventionId=_LONG, QuestionId_DQ=_LONG, TutorId=_LONG, MessageSequence=_INT, IsTutor=_INT, MessageString=_TEXT, TalkMovePrediction=_TEXT),
}
CARDS = _schema(chunk_id=_TEXT, session_id=_LONG, question_id=_LONG, subject_path=_TEXT, source_turn_ids=T.ArrayType(_INT))


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_raw(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A raw CSV by kind: fixed schema, quoted fields over several lines; columns by name, so a renamed tutor column is found."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    schema = RAW[kind]
    rows = reader.csv(path)
    if kind == "dialogues" and "TutorId" not in rows.columns and "UserId" in rows.columns:
        rows = rows.withColumnRenamed("UserId", "TutorId")
    missing = [f.name for f in schema if f.name not in rows.columns]
    if missing:
        raise ValueError(f"{kind} lacks {', '.join(missing)}")
    # cast raises on a bad number: nothing is dropped silently
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def listing(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: what changes when the table is written again."""
    fs, at = _fs(spark, path)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared one that spark.checkpoint.dir names; in local mode, where that is unset, a temporary one. It goes at the driver's exit."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="colloquy-")
    path = f"{where.rstrip('/')}/store-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


_SCRATCH: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            fs, p = _fs(spark, path)
            fs.delete(p, True)
        except Exception:  # the session has ended: its folder goes with the cluster's job
            return


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256, size: int = 16 << 20) -> Iterator[None]:
    """Within it, what goes to Python comes in batches of few rows and bytes, as texts may be long; the session's own settings come back after."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _previous(path: str) -> str:
    return f"{path.rstrip('/')}.previous"


def _replace(spark: SparkSession, beside: str, path: str) -> None:
    """Put what is beside a path in its place. The old content steps aside first and goes last, so at any moment one of both is whole."""
    fs, target = _fs(spark, path)
    new, old = _fs(spark, beside)[1], _fs(spark, _previous(path))[1]
    recover(spark, path)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        if fs.exists(old):
            fs.rename(old, target)
        raise OSError(f"{path} can't be put in place")
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> None:
    """After a writer that died between its renames: the old content comes back if the new one isn't there, and goes if it is."""
    fs, target = _fs(spark, path)
    old = _fs(spark, _previous(path))[1]
    if not fs.exists(old):
        return
    if fs.exists(target):
        fs.delete(old, True)
    elif not fs.rename(old, target):
        raise OSError(f"{path} can't be recovered")


def write_json_lines(df: DataFrame, path: str) -> None:
    """All or nothing: written beside the path, then put in its place; a failure at any point leaves the old or the new rows."""
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.option("ignoreNullFields", "false").json(beside)
    _replace(df.sparkSession, beside, path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Rows in order of key; a malformed line or a repeated key raises, blank lines don't count. A broken write is undone first."""
    recover(spark, path)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    twice = rows.groupBy(key).count().where("count > 1").select(key).first()
    if twice:
        raise ValueError(f"{key} {twice[0]} is repeated")
    return rows.orderBy(key)


def file_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file, read by Spark."""
    rows = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} isn't one file")
    return rows[0].h


class GraphStore:
    """Graph tables by version; a version counts once its manifest, written last, is READY.

    Each write has a folder of its own and adds a row to the manifest, so a failed one changes nothing: the last READY
    write of a version is what readers open, while and after another is made.
    """

    TABLES = {"nodes": "node_id", "edges": "edge_id", "labels": "assignment_id"}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, version: str, source_hash: str, nodes: DataFrame, edges: DataFrame, labels: DataFrame, built_at: str) -> None:
        """Write a version. Repeated edge ids, dangling edges or content that isn't what was written make it FAILED, with the reason.

        Rows are digested while they are written and again when they are read back.
        """
        build = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        at = f"{self.path}/{version}/{build}"
        frames = {"nodes": graph.merge_nodes(nodes), "edges": edges, "labels": labels}
        content = lambda df: [F.count("*").alias("n"), *digests.sums(digests.row_digest(*[F.col(c) for c in df.columns]))]
        seen = {name: Observation() for name in frames}
        for name, df in frames.items():
            df.observe(seen[name], *content(df)).write.parquet(f"{at}/{name}")
        kept = {name: self.spark.read.parquet(f"{at}/{name}") for name in frames}
        found = {name: df.agg(*content(df)).first().asDict() for name, df in kept.items()}
        reason = next((f"{name} differ from what was written" for name in frames if found[name] != seen[name].get), None)
        if reason is None and kept["edges"].groupBy("edge_id").count().where("count > 1").first():
            reason = "repeated edge id"
        elif reason is None and graph.dangling(kept["edges"], kept["nodes"]).first():
            reason = "dangling edge"
        counts = {name: f["n"] for name, f in found.items()}
        row = (version, build, source_hash, counts["nodes"], counts["edges"], counts["labels"], "FAILED" if reason else "READY", built_at, reason)
        manifest = self.spark.createDataFrame([row], "graph_version string, build string, source_hash string, node_count long, edge_count long, label_count long, build_status string, built_at_utc string, failure_reason string")
        manifest.coalesce(1).withColumn("built_at_utc", F.to_timestamp("built_at_utc")).write.mode("append").parquet(f"{self.path}/{version}/manifest")
        if reason:
            raise ValueError(f"graph {version}: {reason}")

    def open(self, version: str, source_hash: str) -> dict[str, DataFrame]:
        """The tables of a READY version of that source, each in order of its key."""
        last = self.spark.read.parquet(f"{self.path}/{version}/manifest").where("build_status = 'READY'").orderBy(F.desc("build")).first()
        if last is None:
            raise ValueError(f"graph {version} isn't ready")
        if last.source_hash != source_hash:
            raise ValueError(f"graph {version} is of another source")
        out = {name: self.spark.read.parquet(f"{self.path}/{version}/{last.build}/{name}") for name in self.TABLES}
        if tuple(out[name].count() for name in self.TABLES) != (last.node_count, last.edge_count, last.label_count):
            raise ValueError(f"graph {version} lacks rows of its manifest")
        return {name: df.orderBy(key) for (name, key), df in zip(self.TABLES.items(), out.values(), strict=True)}


def add_provenance(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Old labels with the session and turns of their nodes filled in; a label that stays without raises."""
    own = nodes.select(F.col("node_id").alias("source_node_id"), F.col("source_session_id").alias("s"), F.col("source_turn_ids").alias("t")).dropDuplicates(["source_node_id"])
    out = labels.join(own, "source_node_id", "left")
    for name, fill in (("source_session_id", "s"), ("source_turn_ids", "t")):
        out = out.withColumn(name, F.coalesce(F.col(name), F.col(fill)) if name in labels.columns else F.col(fill))
    bare = out.where("source_session_id is null or source_turn_ids is null").select("source_node_id").first()
    if bare:
        raise ValueError(f"label of {bare[0]} has no provenance")
    return out.drop("s", "t")


def promote(batch: DataFrame, expected: DataFrame, key: str, path: str) -> None:
    """Write a batch only if its ids are exactly the expected ones."""
    wrong = evidence.id_parity(expected, batch, key).limit(5).collect()
    if wrong:
        raise ValueError("ids differ: " + ", ".join(f"{r[0]} {r.side}" for r in wrong))
    spark, beside = batch.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise ValueError(f"{path} is there already")
    batch.write.parquet(beside)
    if not fs.rename(_fs(spark, beside)[1], target):
        raise OSError(f"{path} can't be put in place")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: written beside its path, then put in its place."""
    fs, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _replace(spark, beside.toString(), path)


def write_report(spark: SparkSession, path: str, title: str, about: dict, observations: list[dict]) -> None:
    """A run's report in a new folder: run.json, observations, failures and slices as JSON lines, and summary.md, which comes last.

    observations: a run's few rows with metric, scope, status, value, threshold. The folder must not be there yet.
    """
    fs, folder = _fs(spark, path)
    if fs.exists(folder):
        raise ValueError(f"{path} is there already")
    failures = [o for o in observations if o["status"] != "SUCCESS"]
    line = lambda o: json.dumps(o, ensure_ascii=False, default=str, sort_keys=True) + "\n"
    counts = {s: sum(o["status"] == s for o in observations) for s in sorted({o["status"] for o in observations})}
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    names = ("metric", "scope", "status", "value", "threshold")
    table = [f"| {' | '.join(names)} |", "|-" * len(names) + "|", *(f"| {' | '.join(cell(o.get(n)) for n in names)} |" for o in failures)] if failures else ["None."]
    summary = [f"# {title}", "", *(f"- {k}: {cell(v)}" for k, v in about.items()), "", "## Status counts", "", *(f"- {s}: {n}" for s, n in counts.items()), "", "## What failed", "", *table, ""]
    write_text(spark, f"{path}/run.json", json.dumps({"title": title, **about, "observations": observations}, ensure_ascii=False, default=str, indent=2, sort_keys=True) + "\n")
    for name, rows in (("observations", observations), ("failures", failures), ("slices", [o for o in observations if o.get("scope") == "slice"])):
        write_text(spark, f"{path}/{name}.jsonl", "".join(map(line, rows)))
    write_text(spark, f"{path}/summary.md", "\n".join(summary))


def open_vectors(spark: SparkSession, path: str, tries: int = 2, opener: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """A vector table, opened again if its first opening fails with an I/O error; other errors and the last one raise."""
    for left in range(tries - 1, -1, -1):
        try:
            return (opener or spark.read.parquet)(path)
        except OSError:
            if not left:
                raise
    raise ValueError("tries must be positive")


def vector_metadata(rows: DataFrame) -> DataFrame:
    """id and a map of metadata from key-value rows (id, key, string_value, int_value, float_value, bool_value) of a vector database."""
    value = F.coalesce("string_value", F.col("int_value").cast("string"), F.col("float_value").cast("string"), F.col("bool_value").cast("string"))
    return rows.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("key", value.alias("value"))))).alias("metadata"))


def snapshot(spark: SparkSession, path: str) -> str:
    """A copy of a folder that later writes to it don't touch: its path."""
    to = scratch(spark)
    fs, source = _fs(spark, path)
    util = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
    other, target = _fs(spark, to)
    if not util.copy(fs, source, other, target, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"{path} can't be copied")
    return to


def fetch(spark: SparkSession, sources: list[str], path: str, read: Callable[[str], bytes]) -> str:
    """The first source that can be read, put at path whole; which one it was. The reader is given, as there may be no network."""
    why = []
    for source in sources:
        try:
            data = read(source)
        except OSError as e:
            why.append(f"{source}: {e}")
            continue
        fs, beside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
        out = fs.create(beside)
        out.write(bytearray(data))
        out.close()
        _replace(spark, beside.toString(), path)
        return source
    raise OSError("no source could be read: " + "; ".join(why))
