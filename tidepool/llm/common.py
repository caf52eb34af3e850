"""Helpers shared by the training-data operators: tables, shared storage, words, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The word pattern of most contracts: everything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where driver and executors are one machine
    may it be unset; then it is a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidepool-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tidepool/{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame) -> DataFrame:
    """df with a column __row that tells its rows apart, the same whenever it is read.

    Rows of a Parquet table are told by their file's number and their place in the file, so no copy is made; the rows of
    anything else are numbered and written.
    """
    try:
        names = sorted(r[0] for r in df.select("_metadata.file_path").distinct().collect())  # a row for each file
        placed = df.select(*df.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return materialize(df.withColumn("__row", F.monotonically_increasing_id()), "keyed")
    if not names:
        return df.withColumn("__row", F.lit(0).cast("long"))
    files = df.sparkSession.createDataFrame([(name, number << 40) for number, name in enumerate(names)], "__file string, __first long")
    return placed.join(files, "__file").select(*df.columns, (F.col("__first") + F.col("__at")).alias("__row"))


def discard(df: DataFrame) -> None:
    """Deletes the files under a materialized DataFrame that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Words of a text with only A-Z lower-cased, as UTF-8. bytes.split() breaks at exactly the contract's white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered between texts; forgets when it has grown past a bound."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hash of each k consecutive word hashes (or rows of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros((n, *words.shape[1:]), dtype=np.uint64)
    for j in range(k):
        out = (out ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def arrow_rows(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Groups the rows of a partition that is sorted by key: (key, rows), one group at a time."""
    held: list[pa.RecordBatch] = []
    current: object = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if held and keys[lo] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = keys[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield current, pa.Table.from_batches(held)


def with_least(pairs: DataFrame, cuts: int = 64) -> DataFrame:
    """Adds m, the least b of each a, to the rows (a, b).

    Minima are taken per (a, slice of the b) and joined back by both, so that the rows of a hub stay dealt over many tasks.
    """
    rows = pairs.withColumn("cut", F.pmod(F.xxhash64("b"), F.lit(cuts)).cast("int"))
    part = rows.groupBy("a", "cut").agg(F.min("b").alias("m"))
    low = part.withColumn("m", F.min("m").over(Window.partitionBy("a")))  # at most `cuts` rows of each a
    return rows.join(low, ["a", "cut"]).select("a", "b", "m")


def _rooted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the edges (a, b) of a task, root the smallest node that these reach."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while x != top:
            above[x], x = top, above[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            above[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(above), pa.int64()), pa.array([root(x) for x in list(above)], pa.int64())], ["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60, task_edges: int = 500_000) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) per node, root the smallest node reachable.

    Up to `task_edges` distinct edges (8 MB) are one task's work. More of them alternate large-star and small-star over
    written tables until nothing changes. Minima are pre-aggregated and joined back by slices, so no node's neighbours are
    gathered in a group or in one task.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= task_edges:
        return materialize(now.coalesce(1).mapInArrow(_rooted, "node long, root long"), "roots")
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        small = with_least(large.where("a <> b").distinct())
        pair = lambda x: F.struct(F.col(x).alias("a"), F.col("m").alias("b"))
        new = materialize(small.select(F.inline(F.array(pair("b"), pair("a")))).where("a <> b").distinct(), "edges")
        got = new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        discard(now)
        now = new
        if mark == tuple(got) or not got[0]:
            break
        mark = tuple(got)
    else:
        raise RuntimeError("components did not converge")
    root = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return root.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
