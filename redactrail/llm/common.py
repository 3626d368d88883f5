"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Unicode's White_Space characters, as a character class of `re`.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"

#: Cuts a text where no byte-level split pattern can look across: before a space that a word follows, and around other
#: white space, of which the last character stands alone if a word follows.
CHUNK = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")

#: Entries of each of the two generations of a worker's memo, its longest words, and the longest of them with punctuation.
MEMO_ENTRIES, MEMO_CHARS, MEMO_JOINED = 350_000, 48, 12


class Memo(dict):
    """A dict of bounded size: when it is full, it becomes the older generation, of which what is used again is kept."""

    def __init__(self, entries: int = MEMO_ENTRIES) -> None:
        self.entries, self.older = entries, {}

    def put(self, key, value) -> None:
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        value = self.older.get(key)
        if value is not None:
            self.put(key, value)
        return value


def quoted(name: str) -> str:
    """A column's name for SQL, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns under the given names; extra columns of any name stay behind."""
    return df.select(*[(F.col(quoted(c)) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def whole(df: DataFrame, id_col: str) -> Column:
    """An id column as 64-bit integers; ValueError for other than whole numbers, which a cast would turn into nulls."""
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be a whole number")
    return F.col(quoted(id_col)).cast("long")


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like `name` that none of the tables has, in any case of letters."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share: the one spark.checkpoint.dir names.

    Only where that is unset and all runs on this machine, as in tests, a folder is made here and set; it goes at the end.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="redactrail-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{what}-{uuid.uuid4().hex}"


#: Paths of working tables that are still there.
WORKING: set[str] = set()


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver's Python and JVM let go of plans that are done with, and so of their shuffles and broadcasts.

    Else plans of many joins fill the JVM's heap up to its limit before it collects them, however little of it is in use.
    """
    gc.collect()  # Python's ends of JVM objects keep those
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, what: str, codec: str = "zstd", narrow: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives a lost executor.

    narrow: an eighth of the shuffle partitions, for tables of a few numbers a row, which would be many tiny files. The
    table stays until forget() or clean(), for what is made of it may be read any time.
    """
    path = shared_folder(df.sparkSession, what)
    if narrow:
        df = df.coalesce(max(8, shuffle_partitions(df.sparkSession) // 8))
    df.write.option("compression", codec).parquet(path)
    WORKING.add(path)
    collect_garbage(df.sparkSession)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.working_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    WORKING.discard(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() of which nothing is read any more."""
    for table in tables:
        _delete(table.sparkSession, table.working_path)


def clean(spark: SparkSession) -> None:
    """Deletes all working tables of this program, once its results are written or collected."""
    for path in list(WORKING):
        _delete(spark, path)


def mapped(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: pa.Schema, spark_schema: str, flush: int = 4096, flush_bytes: int = 16 << 20) -> DataFrame:
    """rows, a generator over a partition's rows, as a DataFrame operation in Arrow batches of bounded size.

    A batch is sent after `flush` rows or about `flush_bytes` bytes of strings and binaries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for at in range(0, batch.num_rows, 256):  # whole columns as Python objects would double the memory
                    yield from zip(*[c.slice(at, 256).to_pylist() for c in columns], strict=True)

        held: list[tuple] = []
        size = 0
        for row in rows(each()):
            held.append(row)
            size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
            if len(held) >= flush or size >= flush_bytes:
                yield record_batch(held, schema)
                held, size = [], 0
        if held:
            yield record_batch(held, schema)

    return df.mapInArrow(run, spark_schema)


def record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def sorted_shards(df: DataFrame, keys: list[str], shards: int, sample: int = 200) -> DataFrame:
    """df dealt into `shards` ranges of the keys and sorted in each; Spark samples the keys of df, so df should be cheap to read."""
    return df.repartitionByRange(shards, *keys).sortWithinPartitions(*keys)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What str.split() splits at, as code points.
SPACES = np.array([*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Characters of a text that are worked on at once.
PIECE = 1 << 19


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text in pieces of about `size` characters, cut at spaces if there are any."""
    if len(text) <= size:
        return [text]
    cuts, at = [], 0
    while len(text) - at > size:
        end = text.rfind(" ", at + 1, at + size)
        if end <= at:
            end = text.find(" ", at + size)
        if end <= at:
            break
        cuts.append(text[at:end])
        at = end
    return [*cuts, text[at:]]


def code_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's code points between two spaces, all white space as spaces; and where there is white space."""
    if text.isascii():
        code = np.frombuffer(f" {text} ".encode(), np.uint8)
        space = (code == 32) | ((code >= 9) & (code <= 13)) | ((code >= 28) & (code <= 31))
    else:
        code = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        space = np.isin(code, SPACES)
    return np.where(space, code.dtype.type(32), code).astype(np.uint64), space


class Powers:
    """Powers of MULTIPLIER and of its inverse, modulo 2**64, as many as were ever needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
            cls.up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, MULTIPLIER)]))
            cls.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, inverse)]))
        return cls.up[:n], cls.down[:n]


def hashes_of_words(code: np.ndarray, space: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of code_points(), in order: its code points as a polynomial."""
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    up, down = Powers.of(len(code))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(code * up)])
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of str.split(), in order."""
    return np.concatenate([hashes_of_words(*code_points(part)) for part in pieces(text)])
