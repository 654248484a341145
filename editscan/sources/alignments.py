"""SAM and BAM as the records table (operators.reads.READS), and back.

BAM splits by byte range: a task finds the first block in its range by the block header, and the
first record in it by a run of well-formed records, as no index is needed for that. Records are
ordered by virtual offset. Tags travel as text; writers give a tag the type its value has.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reads import READS
from . import files
from .text import line_order, numbered

SPLIT = 64 << 20
OPS, NIBBLES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
# Fixed values of the published tag specification: tags of text type whose value may be all digits.
TEXT_TAGS = {"BC", "BQ", "BZ", "CB", "CC", "CO", "CQ", "CR", "CS", "CT", "CY", "FS", "LB", "MC", "MD", "MI", "MM", "OA", "OC", "OQ", "OX", "PG", "PT", "PU", "Q2", "QT", "QX", "R2", "RG", "RX", "SA", "U2", "XA", "YC", "YS"}
_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_PAIR = {bytes([b]): NIBBLES[b >> 4] + NIBBLES[b & 15] for b in range(256)}


# --- SAM


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of a SAM text file; file_ord follows the lines."""
    f = numbered(spark, path).where("line not like '@%' and line <> ''").select(line_order().alias("file_ord"), F.split(F.rtrim("line", F.lit("\r")), "\t").alias("f"))
    text = lambda i: F.nullif(F.col("f")[i], F.lit("*"))
    n = lambda i, t: F.col("f")[i].cast(t)
    tags = F.map_from_entries(F.transform(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, 6, 1 << 30))))
    qual = F.transform(F.filter(F.split(text(10), ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    mate = F.when(F.col("f")[6] == "=", text(2)).otherwise(text(6))
    return f.select("file_ord", F.col("f")[0].alias("qname"), n(1, "int").alias("flag"), text(2).alias("chrom"), (n(3, "bigint") - 1).alias("pos"), n(4, "int").alias("mapq"), text(5).alias("cigar"), mate.alias("next_chrom"), (n(7, "bigint") - 1).alias("next_pos"), n(8, "bigint").alias("tlen"), text(9).alias("seq"), qual.alias("qual"), tags.alias("tags"))


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """ord, chrom, size of the header of a SAM file."""
    h = numbered(spark, path).where("line like '@SQ\t%'").select(line_order().alias("ord"), F.regexp_extract("line", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("line", r"\tLN:(\d+)", 1).cast("bigint").alias("size"))
    return h


def sam_lines(reads: DataFrame) -> DataFrame:
    """file_ord and the SAM line of each record."""
    star = lambda c: F.coalesce(F.col(c), F.lit("*"))
    qual = F.coalesce(F.array_join(F.transform("qual", lambda q: F.char(q + 33)), ""), F.lit("*"))
    mate = F.when(F.col("next_chrom").isNull(), "*").when(F.col("next_chrom") == F.col("chrom"), "=").otherwise(F.col("next_chrom"))
    kind = lambda k, v: F.when(v.rlike(r"^-?\d{1,10}$") & ~k.isin(*sorted(TEXT_TAGS)), F.lit(":i:")).otherwise(F.lit(":Z:"))
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], kind(e["key"], e["value"]), e["value"]))
    fixed = F.concat_ws("\t", "qname", F.col("flag").cast("string"), star("chrom"), (F.coalesce("pos", F.lit(-1)) + 1).cast("string"), F.col("mapq").cast("string"), star("cigar"), mate, (F.coalesce("next_pos", F.lit(-1)) + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"), star("seq"), qual, F.array_join(tags, "\t"))
    return reads.select("file_ord", "chrom", "pos", F.rtrim(fixed, F.lit("\t")).alias("value"))


def sorted_reads(reads: DataFrame, sizes: DataFrame) -> DataFrame:
    """By contig (its place in sizes; those without come last), position and input order; adds ord."""
    return reads.join(sizes.select("chrom", "ord"), "chrom", "left").orderBy(F.asc_nulls_last("ord"), "pos", "file_ord")


def header(sizes: DataFrame) -> tuple[str, list[tuple[str, int]]]:
    refs = [(r["chrom"], r["size"]) for r in sizes.orderBy("ord").collect()]
    return "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{c}\tLN:{n}\n" for c, n in refs), refs


def write_sam(reads: DataFrame, sizes: DataFrame, path: str) -> None:
    """A folder of text parts in coordinate order, the header first."""
    top = reads.sparkSession.createDataFrame([(header(sizes)[0].rstrip("\n"),)], "value string").select(F.lit(-1).cast("bigint").alias("ord"), F.lit(-1).cast("bigint").alias("pos"), F.lit(-1).cast("bigint").alias("file_ord"), "value")
    body = sam_lines(reads).join(sizes.select("chrom", "ord"), "chrom", "left").select(F.coalesce("ord", F.lit(1 << 40)).alias("ord"), "pos", "file_ord", "value")
    top.unionByName(body).orderBy("ord", "pos", "file_ord").select("value").write.mode("errorifexists").text(path)


# --- BAM


def _block(head: bytes, at: int = 0) -> int:
    """Length of the compressed block that begins here, or 0."""
    if len(head) < at + 18 or head[at : at + 4] != b"\x1f\x8b\x08\x04":
        return 0
    end, p = at + 12 + struct.unpack_from("<H", head, at + 10)[0], at + 12
    while p + 4 <= min(end, len(head)):
        size = struct.unpack_from("<H", head, p + 2)[0]
        if head[p : p + 2] == b"BC" and size == 2:
            return struct.unpack_from("<H", head, p + 4)[0] + 1
        p += 4 + size
    return 0


def _blocks(f, length: int, lo: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of blocks from lo on."""
    at = lo
    while at < length:
        f.seek(at)
        head = f.read(1 << 16)
        n = _block(head)
        if not n:
            raise ValueError(f"no block at byte {at}")
        if n > len(head):
            head += f.read(n - len(head))
        skip = 12 + struct.unpack_from("<H", head, 10)[0]
        yield at, zlib.decompress(head[skip : n - 8], -15)
        at += n


def _first_block(f, length: int, lo: int) -> int:
    """The first block at or after lo: a header whose successor is one too, or the file's end."""
    f.seek(lo)
    near = f.read(1 << 18)
    at = near.find(b"\x1f\x8b\x08\x04")
    while at >= 0:
        n = _block(near, at)
        if n and (lo + at + n == length or _block(near, at + n)):
            return lo + at
        at = near.find(b"\x1f\x8b\x08\x04", at + 1)
    return length


def _bam_header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """Contigs, and the block and the place in it of the first record."""
    f, length = files.opened(path)
    held, starts = b"", []
    for at, data in _blocks(f, length, 0):
        starts.append((len(held), at))
        held += data
        try:
            if held[:4] != b"BAM\x01":
                raise ValueError(f"no BAM file: {path}")
            p = 8 + struct.unpack_from("<i", held, 4)[0]
            n, p, refs = struct.unpack_from("<i", held, p)[0], p + 4, []
            for _ in range(n):
                k = struct.unpack_from("<i", held, p)[0]
                refs.append((held[p + 4 : p + 3 + k].decode(), struct.unpack_from("<i", held, p + 4 + k)[0]))
                p += 8 + k
            if p <= len(held):
                s, block = max(x for x in starts if x[0] <= p)
                return refs, block, p - s
        except struct.error:
            continue
    raise ValueError(f"no whole header: {path}")


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(_bam_header(path)[0])], "ord long, chrom string, size long")


def _well_formed(buf: bytes, p: int, sizes: list[int]) -> int:
    """Where the next record starts if one stands here, else 0."""
    size, ref, pos, name, _, _, ops, _, length, nref, npos, _ = struct.unpack_from("<iiiBBHHHiiii", buf, p)
    ok = name >= 2 and length >= 0 and -1 <= ref < len(sizes) and -1 <= nref < len(sizes) and -1 <= pos <= (sizes[ref] if ref >= 0 else 1 << 31) and -1 <= npos <= (sizes[nref] if nref >= 0 else 1 << 31)
    if not ok or size < 32 + name + 4 * ops + (length + 1) // 2 + length or size > 1 << 28:
        return 0
    text = buf[p + 36 : p + 36 + name]
    return p + 4 + size if len(text) < name or text[-1] == 0 and all(33 <= c <= 126 for c in text[:-1]) else 0


def _first_record(buf: bytes, sizes: list[int], more) -> tuple[int, bytes]:
    """Place of the first record: from it on, ten records or all up to the end are well formed."""
    p = 0
    while True:
        while len(buf) < p + 36:
            data = more()
            if data is None:
                return -1, buf
            buf += data
        at, n = p, 0
        while n < 10:
            if len(buf) < at + 36:
                data = more()
                if data is None:
                    break
                buf += data
                continue
            at, n = _well_formed(buf, at, sizes), n + 1
            if not at:
                break
        if at:
            return p, buf
        p += 1


_TYPES = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _tags(buf: bytes, p: int, end: int) -> list[tuple[str, str]]:
    out = []
    while p < end:
        key, kind, p = buf[p : p + 2].decode(), chr(buf[p + 2]), p + 3
        if kind in "ZH":
            z = buf.index(b"\0", p)
            value, p = buf[p:z].decode(), z + 1
        elif kind == "A":
            value, p = chr(buf[p]), p + 1
        elif kind == "B":
            sub, n = chr(buf[p]), struct.unpack_from("<i", buf, p + 1)[0]
            got = struct.unpack_from(f"<{n}{_TYPES[sub]}", buf, p + 5)
            value, p = ",".join([sub, *map(str, got)]), p + 5 + n * struct.calcsize(_TYPES[sub])
        else:
            value, p = str(struct.unpack_from("<" + _TYPES[kind], buf, p)[0]), p + struct.calcsize(_TYPES[kind])
        out.append((key, value))
    return out


def _record(buf: bytes, p: int, refs: list[str | None]) -> tuple:
    size, ref, pos, name, mapq, _, ops, flag, length, nref, npos, tlen = struct.unpack_from("<iiiBBHHHiiii", buf, p)
    at = p + 36 + name
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in struct.unpack_from(f"<{ops}I", buf, at)) or None
    at += 4 * ops
    half = (length + 1) // 2
    seq = "".join(_PAIR[bytes([b])] for b in buf[at : at + half])[:length] or None
    q = buf[at + half : at + half + length]
    qual = None if not length or q[0] == 255 else list(q)
    return buf[p + 36 : p + 35 + name].decode(), flag, refs[ref], pos, mapq, cigar, refs[nref], npos, tlen, seq, qual, _tags(buf, at + half + length, p + 4 + size)


def bam(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Records of a BAM file, a task a range of ``split`` bytes; positions of unplaced records are -1."""
    contigs, first, inside = _bam_header(path)
    length = files.opened(path)[1]
    names, sizes = [*(c for c, _ in contigs), None], [n for _, n in contigs]
    ranges = [(a, min(a + split, length)) for a in range(0, length, split)]
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(READS))

    def run(batches):
        for b in batches:
            for lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from parse(lo, hi)

    def parse(lo, hi):
        f, length = files.opened(path)
        start = first if lo <= first < hi else _first_block(f, length, max(lo, first + 1)) if hi > first else length
        if start >= hi:
            return
        blocks, starts, held = _blocks(f, length, start), [], 0

        def more():
            nonlocal held
            got = next(blocks, None)
            if got is None:
                return None
            starts.append((held, got[0]))
            held += len(got[1])
            return got[1]

        buf, gone, which, rows = more() or b"", 0, 0, []
        if start == first:
            p = inside
        else:
            p, buf = _first_record(buf, sizes, more)
            if p < 0:
                return
        while True:
            while len(buf) < p + 4 or len(buf) < p + 4 + struct.unpack_from("<i", buf, p)[0]:
                data = more()
                if data is None:
                    if len(buf) > p:
                        raise ValueError(f"record breaks off: {path}")
                    break
                if len(buf) == p and not data:
                    continue
                buf, gone, p = buf[p:] + data, gone + p, 0
            if len(buf) == p:
                break
            while which + 1 < len(starts) and starts[which + 1][0] <= gone + p:
                which += 1
            block = starts[which]
            if block[1] >= hi:
                break
            rows.append(((block[1] << 16) + gone + p - block[0], *_record(buf, p, names)))
            p += 4 + struct.unpack_from("<i", buf, p)[0]
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return spark.createDataFrame(ranges, "lo long, hi long").repartition(len(ranges), "lo").mapInArrow(run, READS)


def _bin(start: int, end: int) -> int:
    """The smallest bin of the published scheme that holds [start, end)."""
    end -= 1
    for shift, base in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return base + (start >> shift)
    return 0


def _tag_bytes(key: str, value: str) -> bytes:
    if re.fullmatch(r"-?\d{1,10}", value) and key not in TEXT_TAGS and -(2**31) <= int(value) < 2**31:
        return key.encode() + b"i" + struct.pack("<i", int(value))
    return key.encode() + b"Z" + value.encode() + b"\0"


def _encoded(r: dict, at: dict[str | None, int]) -> bytes:
    ops = [(int(n), OPS.index(o)) for n, o in _CIGAR.findall(r["cigar"] or "")]
    seq, name = r["seq"] or "", r["qname"].encode() + b"\0"
    code = [NIBBLES.find(c) if c in NIBBLES else 15 for c in seq] + [0] * (len(seq) % 2)
    pos = -1 if r["pos"] is None else r["pos"]
    span = sum(n for n, o in ops if OPS[o] in "MDN=X") or 1
    body = struct.pack("<iiBBHHHiiii", at.get(r["chrom"], -1), pos, len(name), r["mapq"] or 0, _bin(max(pos, 0), max(pos, 0) + span) if pos >= 0 else 4680, len(ops), r["flag"], len(seq), at.get(r["next_chrom"], -1), -1 if r["next_pos"] is None else r["next_pos"], r["tlen"] or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + bytes(a << 4 | b for a, b in zip(code[::2], code[1::2]))
    body += bytes(r["qual"]) if r["qual"] is not None and len(r["qual"]) == len(seq) else b"\xff" * len(seq)
    body += b"".join(_tag_bytes(k, v) for k, v in sorted(r["tags"] or []))
    return struct.pack("<i", len(body)) + body


def _compressed(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    z = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(z) + 25) + z + struct.pack("<II", zlib.crc32(data), len(data))


def write_bam(reads: DataFrame, sizes: DataFrame, path: str) -> None:
    """One file in coordinate order: executors sort, encode and compress; the driver passes the blocks on, one task's at a time. No index is written."""
    text, refs = header(sizes)
    at = {c: i for i, (c, _) in enumerate(refs)}

    def run(batches):
        held = b""
        for b in batches:
            for r in b.to_pylist():
                held += _encoded(r, at)
                while len(held) >= 60_000:
                    yield pa.RecordBatch.from_pydict({"z": [_compressed(held[:60_000])]})
                    held = held[60_000:]
        if held:
            yield pa.RecordBatch.from_pydict({"z": [_compressed(held)]})

    head = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in refs)
    body = sorted_reads(reads, sizes).drop("ord").mapInArrow(run, "z binary")
    files.write(path, _all(head, (bytes(r["z"]) for r in body.toLocalIterator())))


def _all(head: bytes, body: Iterator[bytes]) -> Iterator[bytes]:
    for a in range(0, len(head), 60_000):
        yield _compressed(head[a : a + 60_000])
    yield from body
    yield _compressed(b"")
