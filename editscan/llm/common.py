"""Shared pieces: staging tables, token blocks and the block-wise count exchange.

A *token block* is one row holding about ``block_tokens`` tokens of whole documents: the
block's own vocabulary as 64-bit word hashes plus the documents as vocabulary indices. Blocks
let corpus-wide counts travel as sorted, compressed hash lists (one entry per block and
distinct key) instead of one shuffled row per token.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = r"[\x20\x09-\x0D]+"
BLOCK_TOKENS = 1 << 19
KEYS_PER_RANGE = 1 << 21
FAN = 1 << 10
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BLOCK_SCHEMA = "block long, n_docs long, n_tokens long, marked_tokens long, marked_docs long, doc_ids array<long>, marks binary, lens binary, ids binary, vocab binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set here only where unset and the master is this machine alone; an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="editscan-")
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return base


def stage(df: DataFrame, name: str, codec: str = "snappy", by: str | tuple[str, ...] = ()) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage.

    With ``by`` it is a table of the session in buckets of that column, or of those, as many as
    there are shuffle partitions: grouped by them it needs no shuffle. Such tables are to be unstaged.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/editscan/{name}-{uuid.uuid4().hex}"
    # Once the table stands, nobody reads the shuffles that made it; and texts go to Python in small batches.
    made = {_CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
    before = {k: spark.conf.get(k, None) for k in made}
    for k, v in made.items():
        spark.conf.set(k, v)
    try:
        to, table = df.write.option("compression", codec), f"editscan_{name}_{uuid.uuid4().hex}"
        if by:
            to.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *([by] if isinstance(by, str) else by)).option("path", path).saveAsTable(table)
        else:
            to.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.table(table) if by else spark.read.schema(df.schema).parquet(path)
    out._staged, out._table = path, table if by else None
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    if df._table:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(df._staged)
    path.getFileSystem(conf).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(col) -> F.Column:
    """Words [^\\x20\\x09-\\x0D]+ of a string column; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), WORD_SPACE), "")


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once: a lambda's body would work it out for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


_RUN = 256


def running_sums(values: Column) -> Column:
    """Sums of an array up to each element, in runs, so that no long array grows element by element."""
    none = F.array().cast("array<int>")
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    sums = lambda a, start: F.aggregate(a, F.struct(start.alias("at"), none.alias("out")), step)["out"]
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int")), lambda b: F.slice(v, b * _RUN + 1, F.lit(_RUN)))
    total = lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + x)

    def joined(runs):
        ends = sums(F.transform(runs, total), F.lit(0))
        return F.flatten(F.zip_with(runs, F.concat(F.array(F.lit(0)), ends), lambda r, start: F.when(r.isNull(), none).otherwise(sums(r, start))))

    return F.when(F.size(values) > 0, let(values, lambda v: let(cut(v), joined))).otherwise(none)


def crc_mod(id_col: str, mod: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod


def pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that what is made of a piece's texts stays small."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def release() -> None:
    """Gives freed memory back: Python workers are used again, and the next stage's may be others."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def planes(a: np.ndarray, kind: str = "<u8") -> bytes:
    """Counts packed byte plane by byte plane: most are small, and high planes of zeros take no room."""
    kind = np.dtype(kind)
    return pack(a.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T)


def unplanes(b: bytes, kind: str = "<u8") -> np.ndarray:
    kind = np.dtype(kind)
    return np.ascontiguousarray(unpack(b, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def by_frequency(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in order of their frequency, which pack smaller; and the old number of each new one."""
    order = np.argsort(-np.bincount(ids, minlength=size), kind="stable")
    new = np.empty(size, np.int32)
    new[order] = np.arange(size, dtype=np.int32)
    return new[ids], order


class _Vocab(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def token_blocks(docs: DataFrame, text: str, doc_id: str, mark: F.Column | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Token blocks of a table: words are split at ASCII white space and A-Z lower-cased.

    A null or empty text is a document without tokens; a null id stays null; a document longer
    than a block is a block of its own; every input row is kept, repeated rows included.
    ``mark`` flags documents (null counts as false), for instance as training documents.
    """
    if not 0 < block_tokens <= BLOCK_TOKENS:
        raise ValueError("block_tokens must be from 1 to 2^19")
    src = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("t"), F.coalesce(mark if mark is not None else F.lit(False), F.lit(False)).alias("m"))
    schema = _arrow_schema(docs.sparkSession, BLOCK_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        vocab, ids, lens, owners, marks, total = _Vocab(), [], [], [], [], 0

        def flush():
            nonlocal vocab, ids, lens, owners, marks, total, seq
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), np.uint64, len(vocab))
            n, m = np.array(lens, np.int32), np.array(marks, np.uint8)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            flat, order = by_frequency(flat, len(hashes))
            row = [(part << 12) + seq, len(n), int(n.sum()), int(n[m == 1].sum()), int(m.sum()), owners, m.tobytes(), n.tobytes(), planes(flat, "<u4"), hashes[order].tobytes()]
            seq += 1
            if seq == 1 << 12:
                raise ValueError("a partition has too many token blocks; use smaller input splits")
            vocab, ids, lens, owners, marks, total = _Vocab(), [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for b in slices(batches):
            for i, t, m in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2).to_pylist()):
                w = (t.as_py() or b"").lower().split()
                ids.append(np.fromiter(map(vocab.__getitem__, w), np.int32, len(w)))
                lens.append(len(w))
                owners.append(i)
                marks.append(m)
                total += len(w) + 1
                if total >= block_tokens:
                    yield flush()
        if lens:
            yield flush()
        release()

    return src.mapInArrow(run, BLOCK_SCHEMA)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class Block:
    """A token block row as arrays."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.doc_ids = row["doc_ids"]
        self.marks = np.frombuffer(row["marks"], np.uint8).astype(bool)
        self.lens = np.frombuffer(row["lens"], np.int32).astype(np.int64)
        self.ids = unplanes(row["ids"], "<u4").astype(np.int32)
        self.vocab = np.frombuffer(row["vocab"], np.uint64)
        self.doc_of = np.repeat(np.arange(len(self.lens)), self.lens)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)])[:-1]


def blocks_in(batches: Iterator[pa.RecordBatch], kind: type[Block] = Block) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield kind({n: b.column(n)[k].as_py() for n in b.schema.names})


def rows_to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)


def _cut(keys: np.ndarray, low: int, high: int, pieces: int) -> list[int]:
    """Places in ascending keys, all in [low, high), at which as many equal pieces of that range begin; and their end."""
    edges = np.array([low + (high - low) * r // pieces for r in range(1, pieces)], np.uint64)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def _span(slot: int, fans: list[int]) -> tuple[int, int]:
    """The keys of a slot: one piece of the fan-outs so far, cut one after another."""
    digits = []
    for f in reversed(fans):
        slot, d = divmod(slot, f)
        digits.append(d)
    low, high = 0, 1 << 64
    for f, d in zip(fans, reversed(digits)):
        low, high = low + (high - low) * d // f, low + (high - low) * (d + 1) // f
    return low, high


_SENT = "slot long, unit long, keys binary, vals binary"
_BACK = "slot long, unit long, totals binary, n_pos long, top_keys binary, top_totals binary"


def key_exchange(blocks: DataFrame, keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray]], n_keys: int, answer: Callable[[np.ndarray], bytes], read: Callable[[bytes], np.ndarray], value: str = "<u8", top: int = 0, kind: type[Block] = Block, keys_per_range: int | None = None, fan: int = FAN, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Sums per key over all blocks, and an answer made of them returned to every block that holds the key.

    ``keys_of`` gives a block's distinct uint64 keys, ascending, with its values (type ``value``);
    ``n_keys`` is their number in all blocks. Each key's range is summed in one task, which holds
    about ``keys_per_range`` entries. Up to ``fan`` ranges, blocks send to them at once. Beyond,
    entries go there in several hops: a hop sends to ``fan`` slices of the keys at most, and
    there the entries of as many blocks are summed to one block's, so the rows of a hop are in
    proportion to the blocks, and a key that all blocks hold has no more than ``fan`` entries in
    a task. Answers come back the same way. A hop's table holds all its entries; ``scratch`` gets
    the hops' tables, to be unstaged when the rows have been written. Rows: slot, unit (the block), totals (``answer``,
    which ``read`` undoes and the next hop makes again, of the block's keys in the slot, in
    order) and, at unit -1, a row a range with n_pos (keys with a sum above 0) and, where
    ``top`` is not 0, the keys and sums of at least it.
    """
    spark = blocks.sparkSession
    per = keys_per_range or KEYS_PER_RANGE
    ranges, hops = max(1, math.ceil(n_keys / per)), 1
    while fan**hops < ranges:
        hops += 1
    each = max(1, math.ceil(ranges ** (1 / hops)))
    sent, back = _arrow_schema(spark, _SENT), _arrow_schema(spark, _BACK)

    def pieces(slot: int, unit: int, keys: np.ndarray, vals: np.ndarray, fans: list[int]) -> list[tuple]:
        cut = _cut(keys, *_span(slot, fans), each)
        return [(slot * each + r, unit, planes(np.diff(keys[a:b], prepend=np.uint64(0))), planes(vals[a:b], value)) for r, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]

    def send(batches):
        for x in blocks_in(batches, kind):
            yield rows_to_batch(pieces(0, x.block, *keys_of(x), []), sent)
        release()

    def opened(table: pa.Table):
        """Units in order, their keys, the distinct keys with each entry's place among them, and the sums."""
        table = table.sort_by("unit")
        keys = [np.cumsum(unplanes(b.as_py()), dtype=np.uint64) for b in table.column("keys")]
        vals = np.concatenate([unplanes(b.as_py(), value) for b in table.column("vals")])
        uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(uniq), np.dtype(value))
        np.add.at(sums, inv, vals)
        return table.column("unit").to_pylist(), keys, uniq, inv, sums

    def dealt(slot: int, units: list, keys: list, each_: np.ndarray) -> list[tuple]:
        rows, at = [], 0
        for u, k in zip(units, keys):
            rows.append((slot, u, answer(each_[at : at + len(k)]), None, None, None))
            at += len(k)
        return rows

    def merge(fans: list[int]):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            _, _, uniq, _, sums = opened(table)
            slot, crowd = (k.as_py() for k in key)
            return pa.Table.from_batches([rows_to_batch(pieces(slot, crowd, uniq, sums, fans), sent)])

        return run

    def total(table: pa.Table) -> pa.Table:
        units, keys, uniq, inv, sums = opened(table)
        slot = table.column("slot")[0].as_py()
        best = sums >= top if top else np.zeros(len(sums), bool)
        rows = dealt(slot, units, keys, sums[inv])
        rows.append((slot, -1, None, int((sums > 0).sum()), pack(uniq[best]), planes(sums[best], value)))
        return pa.Table.from_batches([rows_to_batch(rows, back)])

    def undo(table: pa.Table, answers: pa.Table) -> pa.Table:
        units, keys, _, inv, _ = opened(table)
        got = _in_order(answers, read)
        return pa.Table.from_batches([rows_to_batch(dealt(table.column("slot")[0].as_py(), units, keys, got[inv]), back)])

    rows, levels, scratch = blocks.mapInArrow(send, _SENT), [], [] if scratch is None else scratch
    n_blocks = blocks.count() if hops > 1 else 0
    for hop in range(1, hops):
        crowd = F.pmod(F.xxhash64("unit"), F.lit(-(-n_blocks // each**hop)))
        rows = stage(rows.withColumn("crowd", crowd).repartition("slot", "crowd"), "hop", by=("slot", "crowd"))
        levels.append(rows)
        rows = rows.groupBy("slot", "crowd").applyInArrow(merge([each] * hop), _SENT)
    out = rows.groupBy("slot").applyInArrow(total, _BACK)
    scratch += levels
    for level in reversed(levels):
        out = stage(out, "answers")
        scratch.append(out)
        down = out.where("unit >= 0").groupBy(F.expr(f"slot div {each}").alias("slot"), F.col("unit").alias("crowd"))
        out = level.groupBy("slot", "crowd").cogroup(down).applyInArrow(undo, _BACK).unionByName(out.where("unit < 0"))
    return out


def _in_order(table: pa.Table, read: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """A unit's answers, in the order of its keys, from its rows of key_exchange."""
    got = sorted(zip(table.column("slot").to_pylist(), table.column("totals").to_pylist()))
    return np.concatenate([read(b) for _, b in got]) if got else read(planes(np.empty(0, np.uint64)))


def count_exchange(blocks: DataFrame, keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray]], n_keys: int, **more) -> DataFrame:
    """key_exchange of counts, each of whose totals returns; read them by totals_of."""
    return key_exchange(blocks, keys_of, n_keys, planes, unplanes, **more)


def totals_of(table: pa.Table) -> np.ndarray:
    return _in_order(table, unplanes)


def flags_exchange(blocks: DataFrame, keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray]], n_keys: int, **more) -> DataFrame:
    """key_exchange of gains (double): whether a key's sum is 0 or more; read by flags_of."""
    return key_exchange(blocks, keys_of, n_keys, _flags, _unflags, value="<f8", **more)


def _flags(sums: np.ndarray) -> bytes:
    return pack((sums if sums.dtype == bool else sums >= 0).astype(np.uint8))


def _unflags(b: bytes) -> np.ndarray:
    return unpack(b, np.uint8).astype(bool)


def flags_of(table: pa.Table) -> np.ndarray:
    return _in_order(table, _unflags) if table.num_rows else np.zeros(0, bool)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps (rewiring every node's larger, then smaller
    neighbours to the smallest one), each round written to the shared folder, until the edge
    set repeats. Self-loops and null ends are ignored; an empty table gives an empty result.
    """
    cur = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), ).where("a is not null and b is not null and a <> b").distinct(), "edges")
    before = None
    while True:
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low2, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        cur = stage(small, "edges")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
