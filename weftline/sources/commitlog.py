"""Tables that grow by whole batches, and tables that change together: folders of Parquet behind a log of commits.

A commit writes its data to a folder of its own and then puts one small file into the log, which fails if
that name is there already. Readers read the folders that the log names and nothing else: what a killed writer left
is never seen, and a batch that is written again adds nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DATA, LOG = "data", "_commits"


class AlreadyCommitted(Exception):
    """The name is in the log: another writer, or an earlier attempt, has committed it."""


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file whole or not at all; AlreadyCommitted if there is one of that name.

    The text goes to a name of its own first; the rename without overwriting decides who comes first (one step in
    HDFS and stores with such a rename; a plain local folder looks and then renames).
    """
    sc = spark.sparkContext
    jvm, fs, at = sc._jvm, _fs(spark, path), _path(spark, path)
    staged = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(staged), fs.makeQualified(at), sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as error:
        fs.delete(staged, False)
        if fs.exists(at):
            raise AlreadyCommitted(path) from error
        raise


def entries(spark: SparkSession, root: str) -> list[tuple[str, dict]]:
    """Names and contents of all commits of a log, by name."""
    fs, log = _fs(spark, root), _path(spark, f"{root}/{LOG}")
    if not fs.exists(log):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(log) if f.getPath().getName().endswith(".json"))
    if not names:
        return []
    lines = spark.read.option("wholetext", True).text([f"{root}/{LOG}/{n}" for n in names]).select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"))
    return sorted((r["name"].removesuffix(".json"), json.loads(r["value"])) for r in lines.collect())


# --- appended batches ---------------------------------------------------------------------------


@dataclass
class BatchLog:
    """A table that batches are appended to exactly once, each under the name of its writer and its number."""

    spark: SparkSession
    root: str
    schema: str

    def key(self, writer: str, batch: int | str) -> str:
        return f"{writer}-{batch:020d}" if isinstance(batch, int) else f"{writer}-{batch}"

    def append(self, rows: DataFrame, writer: str, batch: int | str, before_commit: Callable[[], None] | None = None) -> bool:
        """Adds a batch, or does nothing and says so if the log has it. ``before_commit`` runs between writing and committing (tests end the writer there)."""
        name = self.key(writer, batch)
        fs = _fs(self.spark, self.root)
        if fs.exists(_path(self.spark, f"{self.root}/{LOG}/{name}.json")):
            return False
        folder = f"{DATA}/{name}-{uuid.uuid4().hex[:12]}"
        kinds = self.spark.createDataFrame([], self.schema).schema
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]).write.parquet(f"{self.root}/{folder}")
        if before_commit is not None:
            before_commit()
        try:
            put_if_absent(self.spark, f"{self.root}/{LOG}/{name}.json", json.dumps({"folder": folder, "at": time.time()}))
        except AlreadyCommitted:
            fs.delete(_path(self.spark, f"{self.root}/{folder}"), True)
            return False
        return True

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: a batch that Spark hands over again after a failure is in the log and adds nothing."""
        return lambda rows, batch: (self.append(rows, writer, int(batch)), None)[1]

    def read(self, since: str | None = None) -> DataFrame:
        """All committed rows; with ``since``, those of batches whose names come after it."""
        folders = [f"{self.root}/{e['folder']}" for n, e in entries(self.spark, self.root) if since is None or n > since]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def swept(self, older_than: float) -> int:
        """Deletes data folders that no commit names and that were made before that time (seconds); returns how many."""
        fs, data = _fs(self.spark, self.root), _path(self.spark, f"{self.root}/{DATA}")
        if not fs.exists(data):
            return 0
        named = {e["folder"].rpartition("/")[2] for _, e in entries(self.spark, self.root)}
        stale = [f.getPath() for f in fs.listStatus(data) if f.getPath().getName() not in named and f.getModificationTime() < older_than * 1000]
        for at in stale:
            fs.delete(at, True)
        return len(stale)


def ledger_rows(calls: DataFrame) -> DataFrame:
    """Calls as the ledger keeps them: a failed call is a row with its error, an estimated cost is marked in its usage,
    a missing cost is zero, and a request or response that is no JSON is kept as a JSON string."""
    usage = F.coalesce("usage", F.lit("{}"))
    mark = F.when(F.coalesce("estimated", F.lit(False)), F.concat(F.regexp_replace(usage, r"\}\s*$", ""), F.when(F.trim(usage).rlike(r"^\{\s*\}$"), "").otherwise(","), F.lit('"cost_estimated":true}'))).otherwise(F.col("usage"))
    as_json = lambda c: F.when(F.try_parse_json(c).isNotNull() | F.col(c).isNull(), F.col(c)).otherwise(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    return calls.select(
        "id", "project_id", "run_id", "target_id", "model_slug", "provider", "error", F.col("stage").cast("int").alias("stage"), F.coalesce(F.col("latency_ms").cast("int"), F.lit(0)).alias("latency_ms"),
        as_json("request").alias("request"), as_json("response").alias("response"), mark.alias("usage"), F.coalesce(F.col("cost_usd").cast("double"), F.lit(0.0)).alias("cost_usd"), F.col("created_at").cast("double").alias("created_at"),
    )


EXPORTS = "id string, project_id string, path string, formats array<string>, counts map<string,map<string,int>>, created_at double"


def record_export(log: BatchLog, id_: str, project_id: str, path: str, formats: list[str], counts: Mapping[str, Mapping[str, int]], created_at: float | None = None) -> bool:
    """Adds the record of an export once; False if its id is there already."""
    row = (id_, project_id, path, formats, {k: dict(v) for k, v in counts.items()}, time.time() if created_at is None else created_at)
    return log.append(log.spark.createDataFrame([row], EXPORTS), "export", id_)


# --- tables that change together ----------------------------------------------------------------


class Conflict(Exception):
    """Another commit came in between: read again and retry."""


@dataclass
class Snapshots:
    """Several tables whose changes become visible at once: version n of all is one file of the log.

    A commit writes the tables that change into new folders and names all tables in the log under the next number.
    Of two writers that started from one version, the second gets a Conflict. Old folders stay for readers that have
    them open.
    """

    spark: SparkSession
    root: str

    def version(self) -> tuple[int, dict[str, list[str]]]:
        """The last version (0: none), and the folder and schema of each of its tables."""
        found = entries(self.spark, self.root)
        return (int(found[-1][0]), found[-1][1]["tables"]) if found else (0, {})

    def read(self, at: int | None = None) -> dict[str, DataFrame]:
        """All tables of a version, the last by default."""
        if at is None:
            _, tables = self.version()
        else:
            tables = next(e["tables"] for n, e in entries(self.spark, self.root) if int(n) == at)
        return {n: self.spark.read.schema(StructType.fromJson(json.loads(kind))).parquet(f"{self.root}/{folder}") for n, (folder, kind) in tables.items()}

    def commit(self, base: int, changed: Mapping[str, DataFrame], before_commit: Callable[[], None] | None = None) -> int:
        """Makes version ``base`` + 1 of the changed tables and all others as they are; Conflict if there is one."""
        number, tables = self.version()
        if number != base:
            raise Conflict(f"version {number} is there, not {base}")
        tables = dict(tables)
        for name, df in changed.items():
            folder = f"{DATA}/{name}-{base + 1}-{uuid.uuid4().hex[:12]}"
            df.write.parquet(f"{self.root}/{folder}")
            tables[name] = [folder, df.schema.json()]
        if before_commit is not None:
            before_commit()
        try:
            put_if_absent(self.spark, f"{self.root}/{LOG}/{base + 1:020d}.json", json.dumps({"tables": tables, "at": time.time()}))
        except AlreadyCommitted as error:
            raise Conflict(f"version {base + 1} was committed meanwhile") from error
        return base + 1
