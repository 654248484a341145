"""bigWig tracks: read by index subtree on executors; written from sections that executors compress."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

MAGIC, TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
ITEMS, FAN = 1024, 256
_TRACK = "chrom string, pos long, value double"


def _header(f) -> tuple[dict[int, tuple[str, int]], int, int, str]:
    """Contigs by id, the index's root, the size of inflated sections, and the byte order."""
    f.seek(0)
    h = f.read(64)
    order = "<" if struct.unpack("<I", h[:4])[0] == MAGIC else ">"
    if struct.unpack(order + "I", h[:4])[0] != MAGIC:
        raise ValueError("no bigWig file")
    _, _, tree, _, index, *_, room, _ = struct.unpack(order + "HHQQQHHQQIQ", h[4:])
    f.seek(tree)
    _, _, key, _, _, _ = struct.unpack(order + "IIIIQQ", f.read(32))
    contigs, todo = {}, [tree + 32]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack(order + "BBH", f.read(4))
        for _ in range(n):
            name = f.read(key)
            if leaf:
                i, size = struct.unpack(order + "II", f.read(8))
                contigs[i] = (name.rstrip(b"\0").decode(), size)
            else:
                todo.append(struct.unpack(order + "Q", f.read(8))[0])
    return contigs, index + 48, room, order


def _node(f, at: int, order: str) -> tuple[bool, list[tuple]]:
    f.seek(at)
    leaf, _, n = struct.unpack(order + "BBH", f.read(4))
    kind = struct.Struct(order + ("IIIIQQ" if leaf else "IIIIQ"))
    return bool(leaf), list(kind.iter_unpack(f.read(kind.size * n)))


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """ord, chrom, size."""
    return spark.createDataFrame([(i, *c) for i, c in sorted(_header(files.opened(path)[0])[0].items())], "ord long, chrom string, size long")


def _section(data: bytes, order: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Contig id, and position and value of every base of a section."""
    chrom, start, _, step, span, kind, _, n = struct.unpack_from(order + "IIIIIBBH", data)
    words = np.frombuffer(data, order + "u4", offset=24, count=n * {1: 3, 2: 2, 3: 1}[kind]).reshape(n, -1)
    value = words[:, -1].copy().view(order + "f4").astype(float)
    first = words[:, 0].astype(np.int64) if kind < 3 else start + step * np.arange(n, dtype=np.int64)
    width = words[:, 1].astype(np.int64) - first if kind == 1 else np.full(n, span, np.int64)
    at = np.repeat(first - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
    return chrom, at, np.repeat(value, width)


def read(spark: SparkSession, path: str, tasks: int = 200) -> DataFrame:
    """chrom, pos, value of every base that the file gives a value."""
    f, _ = files.opened(path)
    names, root, room, order = _header(f)
    nodes = [root]
    while len(nodes) < tasks:
        seen = [_node(f, n, order) for n in nodes]
        if not seen or any(leaf for leaf, _ in seen):
            break
        nodes = [x[4] for _, items in seen for x in items]

    def run(batches):
        g, _ = files.opened(path)
        for b in batches:
            todo = b.column(0).to_pylist()[::-1]
            while todo:
                leaf, items = _node(g, todo.pop(), order)
                if not leaf:
                    todo += [x[4] for x in items][::-1]
                    continue
                for *_, at, size in items:
                    g.seek(at)
                    data = g.read(size)
                    chrom, pos, value = _section(zlib.decompress(data) if room else data, order)
                    for a in range(0, len(pos), 1 << 20):
                        p, v = pos[a : a + (1 << 20)], value[a : a + (1 << 20)]
                        yield pa.RecordBatch.from_arrays([pa.array([names[chrom][0]] * len(p), pa.string()), pa.array(p), pa.array(v)], names=["chrom", "pos", "value"])

    return spark.createDataFrame([(n,) for n in nodes], "node long").repartition(len(nodes), "node").mapInArrow(run, _TRACK)


def write(track: DataFrame, sizes: DataFrame, path: str) -> None:
    """A file with all contigs of sizes and the track's values other than 0, sorted, a span of one base each.

    Values are single precision, as the format has it. The driver passes on the compressed
    sections, one task's at a time, and holds their index: 32 bytes for up to 1,024 values, so no
    more than a genome's length asks for. There are no zoom levels. Unknown contigs drop out.
    """
    refs = [(r["chrom"], r["size"]) for r in sizes.orderBy("ord").collect()]
    if not 0 < len(refs) < 1 << 16:
        raise ValueError("a file has from 1 to 65,535 contigs")
    ids = {c: i for i, (c, _) in enumerate(refs)}

    def pack(i: int, pos: np.ndarray, value: np.ndarray) -> dict:
        items = np.rec.fromarrays([pos.astype("<u4"), value.astype("<f4")]).tobytes()
        data = struct.pack("<IIIIIBBH", i, int(pos[0]), int(pos[-1]) + 1, 0, 1, 2, 0, len(pos)) + items
        v = value.astype("<f4").astype(float)
        return {"id": i, "a": int(pos[0]), "z": int(pos[-1]) + 1, "raw": len(data), "n": len(pos), "low": v.min(), "high": v.max(), "total": v.sum(), "squares": (v * v).sum(), "data": zlib.compress(data)}

    ddl = "id long, a long, z long, raw long, n long, low double, high double, total double, squares double, data binary"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches):
        i, pos, value = None, np.empty(0, np.int64), np.empty(0)
        for b in batches:
            chroms, p, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(), b.column(2).to_numpy()
            cut = [0, *(np.flatnonzero(chroms[1:] != chroms[:-1]) + 1).tolist(), len(p)]
            out = []
            for x, y in zip(cut, cut[1:]):
                if y == x:
                    continue
                if ids[chroms[x]] != i and len(pos):
                    out += [pack(i, pos, value)]
                    pos, value = pos[:0], value[:0]
                i = ids[chroms[x]]
                pos, value = np.concatenate([pos, p[x:y]]), np.concatenate([value, v[x:y]])
                whole = len(pos) // ITEMS * ITEMS
                out += [pack(i, pos[k : k + ITEMS], value[k : k + ITEMS]) for k in range(0, whole, ITEMS)]
                pos, value = pos[whole:], value[whole:]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if len(pos):
            yield pa.RecordBatch.from_pylist([pack(i, pos, value)], schema=schema)

    rows = track.where("value <> 0").join(sizes.select("chrom", "ord"), "chrom").orderBy("ord", "pos").select("chrom", F.col("pos").cast("bigint").alias("pos"), F.col("value").cast("double").alias("value"))
    key = max(len(c.encode()) for c, _ in refs)
    tree = struct.pack("<IIIIQQ", TREE, len(refs), key, 8, len(refs), 0) + struct.pack("<BBH", 1, 0, len(refs)) + b"".join(c.encode().ljust(key, b"\0") + struct.pack("<II", i, n) for i, (c, n) in enumerate(refs))
    at = 64 + 40
    start = at + len(tree)
    # The header says where the index begins and what all values sum up to, so sections wait in a staged table until that is known.
    from ..plans.staging import stage

    made = stage(rows.mapInArrow(run, ddl).withColumn("nth", F.monotonically_increasing_id()), "bigwig")
    info = made.select("id", "a", "z", F.length("data").alias("size"), "raw", "n", "low", "high", "total", "squares", "nth").orderBy("nth").toPandas()
    ends = start + 8 + info["size"].cumsum().to_numpy()
    index = int(ends[-1]) if len(ends) else start + 8
    leaves = [(int(i), int(a), int(i), int(z), int(e - s), int(s)) for i, a, z, e, s in zip(info["id"], info["a"], info["z"], ends, info["size"])]
    some = len(info) > 0
    head = struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, 0, at, start, index, 0, 0, 0, 64, int(info["raw"].max()) if some else 24, 0)
    sums = struct.pack("<Qdddd", int(info["n"].sum()), *((float(info["low"].min()), float(info["high"].max()), float(info["total"].sum()), float(info["squares"].sum())) if some else (0.0,) * 4))

    def pieces():
        yield head + sums + tree + struct.pack("<Q", len(leaves))
        for r in made.orderBy("nth").select("data").toLocalIterator():
            yield bytes(r["data"])
        yield _index(leaves, index) + struct.pack("<I", MAGIC)

    files.write(path, pieces())


def _index(leaves: list[tuple], at: int) -> bytes:
    """The index: levels of nodes of FAN items, the root first."""
    levels = [[leaves[k : k + FAN] for k in range(0, len(leaves), FAN)] or [[]]]
    span = lambda items: (*min(x[:2] for x in items), *max(x[2:4] for x in items))
    while len(levels[0]) > 1:
        below = levels[0]
        levels.insert(0, [[(*span(n),) for n in below[k : k + FAN]] for k in range(0, len(below), FAN)])
    whole = span(leaves) if leaves else (0, 0, 0, 0)
    out = [struct.pack("<IIQIIIIQII", INDEX, FAN, len(leaves), *whole, at, ITEMS, 0)]
    spot = at + 48
    for depth, level in enumerate(levels):
        leaf = depth == len(levels) - 1
        spot += sum(4 + (32 if leaf else 24) * len(n) for n in level)
        child, below = spot, iter(() if leaf else levels[depth + 1])
        for node in level:
            out.append(struct.pack("<BBH", leaf, 0, len(node)))
            for item in node:
                if leaf:
                    out.append(struct.pack("<IIIIQQ", *item))
                else:
                    out.append(struct.pack("<IIIIQ", *item, child))
                    child += 4 + (32 if depth == len(levels) - 2 else 24) * len(next(below))
    return b"".join(out)
