"""What the operators of this subpackage share: inputs, shared tables, word rules."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and its complement, as the contracts define words, and its characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only on a local master, as in tests, a fresh local folder stands in where it is unset;
    on a cluster, machines would not see each other's folders.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
    return _own_dirs[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors, fixes values such as row numbers, and lets
    later steps read single columns of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"
    for made in _leftovers:
        made.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Leftovers:
    """The tables that are staged while it is open as a context; drop() deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Leftovers:
        _leftovers.append(self)
        return self

    def __exit__(self, *_) -> None:
        _leftovers.remove(self)

    def drop(self, but: DataFrame) -> None:
        """Deletes all but what `but` reads."""
        read = {name.rsplit("/", 1)[0].rsplit("/", 1)[-1] for name in but.inputFiles()}
        for path in self.paths:
            if path.rsplit("/", 1)[-1] not in read:
                delete(self.spark, path)
        self.paths = []


_leftovers: list[Leftovers] = []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row number that later reads see alike, since ids may be null or repeated,
    and the number's name, which no column of docs has.

    Of a table as Spark wrote it the number is that of the file and the place in it, and
    nothing is copied; other tables are staged with a number.
    """
    row = free_name(docs, "row_number")
    parts = [re.search(r"/part-(\d+)-[^/]*$", name) for name in docs.inputFiles()]
    plain = docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in docs.columns
    if plain and parts and all(parts) and len({m[1] for m in parts}) == len(parts):
        part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)-", 1).cast("long")
        return docs.select("*", (F.shiftleft(part, 40) + F.col("_metadata.row_index")).alias(row)), row
    return staged(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later step reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("tessera-"):
            path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def released() -> None:
    """Hands freed memory back to the machine, since a worker lives on for later stages."""
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


class TwoGenerations:
    """What a task remembers of texts, in two halves of bounded size: the older one goes when the newer is full."""

    def __init__(self, most: int):
        self.most, self.held, self.young, self.old, self.each = most, 0.0, {}, {}, 0.0

    def recall(self, keys: set) -> tuple[dict, list]:
        """What is known of the keys, and the keys that nothing is known of."""
        known, fresh = {}, []
        young, old = self.young, self.old
        before = len(young)
        for key in keys:
            if key in young:
                known[key] = young[key]
            elif key in old:
                known[key] = young[key] = old[key]
            else:
                fresh.append(key)
        self.held += (len(young) - before) * self.each  # those that moved on, at the older half's mean
        return known, fresh

    def learn(self, keys: list, values: list, size: int) -> None:
        """Remembers values that take `size` bytes together, keys included."""
        if 2 * (self.held + size) > self.most and self.young:
            self.each = self.held / len(self.young)
            self.old, self.young, self.held = self.young, {}, 0.0
        self.young.update(zip(keys, values))
        self.held += size


def small_batches(spark: SparkSession, rows: int = 1_000, size: str = "16m") -> None:
    """Bounds the batches that go to Python workers in this session, since texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds: the split that the contracts fix."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)).cast("int")


#: Characters of training texts that one fit takes, besides its bound on rows.
TRAINING_CHARS = 48_000_000


def fitted(sample: DataFrame, train, columns: list[str], order: list[str], text: str | None = None, most_chars: int = TRAINING_CHARS):
    """What train(table) returns for the bounded sample, trained in one task of an executor.

    train gets a pyarrow table of the columns, in the given order, and returns any picklable
    model of bounded size. The sample has a bounded number of rows; rows that stand behind
    the first most_chars characters of the text column, whole texts, are left out too, so the
    task's memory is bounded however long the texts are. A lost executor only repeats the task.
    """
    import pickle

    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        got, chars = [], 0
        for batch in batches:
            if text is not None:
                lengths = pc.fill_null(pc.utf8_length(batch.column(text)), 0)
                before = [chars + n for n in [0, *pc.cumulative_sum(lengths).to_pylist()]]
                taken = sum(n < most_chars for n in before[:-1])
                chars = before[-1]
                batch = batch.slice(0, taken)
            if batch.num_rows:
                got.append(batch)
        if got:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(pa.Table.from_batches(got)))], pa.binary())], names=["model"])
        del got
        released()

    rows = sample.select(*columns).repartition(1).sortWithinPartitions(*order).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0][0]) if rows else None
