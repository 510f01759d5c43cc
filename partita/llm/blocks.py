"""Block rounds: the exchange that the heavier operators of this package share.

Documents are cut into *blocks* of a few MB.  In a round, every block asks a question about
many 64-bit keys; each key belongs to one of ``n`` *owners*; a block sends each of its distinct
keys once to the key's owner, the owner combines what all blocks said about that key and
answers each block in the order in which the block asked.

* A key that a third of all rows share costs one entry per block, never one per row, so no
  owner gets a hot group.
* Keys are hashes, so owners are even; ``repartitionById`` deals them one owner to a task.
* Blocks and owners hold a bounded amount of data, whatever the corpus size is: the number of
  owners follows the input's size.
* Every step is a pure function of its input rows, so lost tasks can be run again.  The input
  must be deterministic (a table, or a checkpointed frame), because the blocks of a scan are
  named by partition and position.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20
OWNER_BYTES = 8 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
_STATE = "block long, owner int, data binary"
_MESSAGE = "owner int, block long, data binary"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# --- compression of arrays and documents -------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays to bytes: the byte planes of each array, compressed together."""
    head, body = [np.int64(len(arrays)).tobytes()], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(np.array([len(a), a.itemsize, ord(a.dtype.kind)], dtype=np.int64).tobytes())
        body.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes())
    return zstandard.compress(b"".join(head + body), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    info = np.frombuffer(raw, np.int64, 3 * n, 8).reshape(n, 3)
    at, out = 8 + 24 * n, []
    for length, width, kind in info.tolist():
        planes = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"{chr(kind)}{width}"))
        at += length * width
    return out


def pack_sorted(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted unsigned keys; :func:`unpack_sorted` undoes it."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def unpack_sorted(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number): an order by (a, b) and the number of each ordered pair among the distinct ones.

    Sorting by a alone is far faster than sorting pairs; b only decides where equal a's are mixed."""
    order = np.argsort(a)
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = x[1:] == x[:-1]
    new = np.ones(len(a), dtype=bool)
    new[1:] = ~same | (y[1:] != y[:-1])
    return order, np.cumsum(new) - 1


def table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def bytes_table(data: bytes | pa.Table) -> pa.Table:
    if isinstance(data, pa.Table):  # a block on its first way, which was not packed
        return data
    return pa.ipc.open_stream(data).read_all()


# --- blocks ------------------------------------------------------------------------------


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Rows in their order, in tables of about ``size`` bytes of text and one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64) + 64
        part = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield pa.Table.from_batches([batch.slice(a, b - a)])


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, most: int = 1000) -> None:
    """Arrow batches of at most so many rows, unless the session says otherwise: the default of 10,000 long texts
    takes tens of MB in the JVM, outside its heap, and as much again in each Python worker."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(most))


class Docs:
    """Documents as the blocks of a first round: what they ask is told where they are read."""

    def __init__(self, docs: DataFrame, size: int = BLOCK_BYTES):
        short_batches(docs.sparkSession)
        self.frame, self.size = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), size

    def cut(self, batches) -> Iterator[tuple[int, pa.Table]]:
        first = TaskContext.get().partitionId() << 32
        for k, table in enumerate(chunks(batches, size=self.size)):
            yield first + k, table


_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the folder that the cluster names; the shuffle files
    behind it go when it is written."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        return df.select("*").checkpoint()  # a new query, which reads the setting
    finally:
        spark.conf.unset(_DROP) if before is None else spark.conf.set(_DROP, before)


def tabled(df: DataFrame) -> DataFrame:
    """Cuts lineage with a written table in the shared folder.  Unlike a checkpoint, a table has a size that
    Spark reads anew, so estimates do not multiply from round to round of a loop of joins."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.kept_at = path
    return out


def forget(df: DataFrame) -> None:
    """Removes the files of a checkpointed or tabled frame that nothing will read again."""
    spark, file = df.sparkSession, getattr(df, "kept_at", None)
    if file is None:
        found = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        file = found.get() if found.isDefined() else None
    if file:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def trimmed() -> None:
    """Gives freed memory back to the system, so that workers that wait do not hold what their last block took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")


def plan_bytes(df: DataFrame) -> int:
    """The plan's size; where Spark does not know it (it then says the largest number), the texts are measured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 55:
        size = df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return size


def owners(df: DataFrame, per_owner: int = OWNER_BYTES) -> int:
    """How many owners: by the input's size, and as many as the session's shuffle partitions at least."""
    size = plan_bytes(df)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, size // per_owner + 1)


def owner_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Owners by ranges of the keys' upper half, so that sorted keys are sorted by owner."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def owner_cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each owner's keys begin in sorted keys; n + 1 places."""
    return np.searchsorted(owner_of(keys, n), np.arange(n + 1))


Send = Callable[[int, bytes], Iterator[tuple[int, bytes]]]
Answer = Callable[[int, list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]


def ask(state: DataFrame | Docs, n: int, send: Send, answer: Answer, fold, schema: str) -> DataFrame:
    """One round.

    ``send(block, data)`` yields (owner, message); ``answer(owner, messages)`` gets the pairs
    (block, message) of one owner and yields (block, reply); ``fold(block, data, replies)`` gets
    the replies by owner and yields record batches of ``schema``.  A block of ``Docs`` is sent as
    a table and comes packed to ``fold``.
    """

    def messages_of(block, data):
        told = list(send(block, data))
        if told:
            yield _rows([owner for owner, _ in told], [block] * len(told), [m for _, m in told])
        del told
        trimmed()

    def sending(batches):
        if isinstance(source, Docs):
            for block, table in source.cut(batches):
                yield from messages_of(block, table)
            return
        for batch in batches:
            for block, data in zip(batch["block"].to_pylist(), batch["data"], strict=True):
                yield from messages_of(block, data.as_py())

    def packing(batches):
        for block, table in source.cut(batches):
            yield state_row(block, table_bytes(table))

    def answering(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for owner, block, data in zip(*(batch[k].to_pylist() for k in ("owner", "block", "data")), strict=True):
                got.setdefault(owner, []).append((block, data))
        for owner in sorted(got):
            told = list(answer(owner, sorted(got.pop(owner))))
            if told:
                yield pa.RecordBatch.from_pydict({"block": [block for block, _ in told], "owner": pa.array([owner] * len(told), pa.int32()), "data": [reply for _, reply in told]})
            del told
            trimmed()

    def folding(table):
        own, replies = None, {}
        block = table["block"][0].as_py()
        for owner, data in zip(table["owner"].to_pylist(), table["data"], strict=True):
            if owner < 0:
                own = data.as_py()
            else:
                replies[owner] = data.as_py()
        out = list(fold(block, own, replies))
        del own, replies
        trimmed()
        return pa.Table.from_batches(out) if out else pa.Table.from_pylist([], schema=to_arrow(schema))

    if isinstance(state, Docs):
        frame, source = state.frame, Docs.__new__(Docs)  # without the frame, which does not travel
        source.size = state.size
        own = frame.mapInArrow(packing, _STATE)
    else:
        frame, source = state, None
        own = state.select("block", "owner", "data")
    replies = frame.mapInArrow(sending, _MESSAGE).repartitionById(n, F.col("owner")).mapInArrow(answering, _STATE)
    return own.unionByName(replies).groupBy("block").applyInArrow(folding, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def to_arrow(schema: str) -> pa.Schema:
    """The Arrow form of a flat schema; executors have no session to parse it with."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in schema.split(","))])


def rows(schema: str, **columns) -> pa.RecordBatch:
    want = to_arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in want], schema=want)


def _rows(owner, block, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"owner": pa.array(owner, pa.int32()), "block": block, "data": data})


STATE = _STATE


def state_row(block: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": [block], "owner": pa.array([-1], pa.int32()), "data": [data]})
