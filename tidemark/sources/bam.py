"""A BAM data source: ``spark.read.format("bam").load(path)`` after ``register(spark)``.

Files are cut at compressed block boundaries into splits of ``split_bytes`` (64 MB by default), found again by the blocks'
magic and by records that parse, so that one large file spreads over tasks. With an index beside the file and the option
``region`` (``chrom:start-end``) only the splits that may hold overlapping reads are planned.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.text import usable

SCHEMA = "name string, flag int, chrom string, pos int, mapq int, cigar string, ref_len int, mate_chrom string, mate_pos int, tlen int, seq string, qual binary, md string"
_OPS, _BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
_MAGIC = b"\x1f\x8b\x08\x04"


def blocks(f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of the compressed blocks that begin in ``[start, stop)``."""
    f.seek(start)
    at = start
    while at < stop:
        head = f.read(18)
        if len(head) < 18:
            return
        if head[:4] != _MAGIC:
            raise ValueError(f"no block at {at}")
        size = struct.unpack_from("<H", head, 16)[0] + 1
        yield at, zlib.decompress(f.read(size - 18)[:-8], -15)
        at += size


def _next_block(f, start: int, size: int) -> int:
    """Where the first block at or after ``start`` begins: a magic whose block is followed by another, or by the end."""
    f.seek(start)
    window = f.read(1 << 17)
    k = window.find(_MAGIC)
    while k >= 0:
        if k + 18 <= len(window):
            end = start + k + struct.unpack_from("<H", window, k + 16)[0] + 1
            f.seek(end)
            if end == size or f.read(4) == _MAGIC:
                return start + k
        k = window.find(_MAGIC, k + 1)
    return size


def header(path: str) -> tuple[list[tuple[str, int]], int, int]:
    """Reference names and lengths, and where the records begin: (block offset, offset in the block)."""
    with open(path, "rb") as f:
        data, starts = b"", []
        for at, d in blocks(f, 0, os.path.getsize(path)):
            starts.append((len(data), at))
            data += d
            try:
                if data[:4] != b"BAM\1":
                    raise ValueError(f"no BAM file: {path}")
                p = 8 + struct.unpack_from("<i", data, 4)[0]
                n, p = struct.unpack_from("<i", data, p)[0], p + 4
                refs = []
                for _ in range(n):
                    k = struct.unpack_from("<i", data, p)[0]
                    refs.append((data[p + 4 : p + 3 + k].decode(), struct.unpack_from("<i", data, p + 4 + k)[0]))
                    p += 8 + k
                if p <= len(data):
                    base, block = [s for s in starts if s[0] <= p][-1]
                    return refs, block, p - base
            except struct.error:
                continue
    raise ValueError(f"the header does not end: {path}")


def _tag(data: bytes, p: int, end: int, want: bytes) -> str | None:
    sizes = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}
    while p + 3 <= end:
        name, kind = data[p : p + 2], data[p + 2 : p + 3]
        p += 3
        if kind in (b"Z", b"H"):
            q = data.index(b"\0", p)
            if name == want:
                return data[p:q].decode()
            p = q + 1
        elif kind == b"B":
            p += 5 + sizes[data[p : p + 1]] * struct.unpack_from("<i", data, p + 1)[0]
        else:
            p += sizes[kind]
    return None


def record(data: bytes, p: int, refs: list[tuple[str, int]]) -> tuple:
    """The fields of the record whose body begins at ``p`` (after its size)."""
    size = struct.unpack_from("<i", data, p - 4)[0]
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data, p)
    q = p + 32
    name = data[q : q + n_name - 1].decode()
    q += n_name
    ops = struct.unpack_from(f"<{n_cigar}I", data, q)
    q += 4 * n_cigar
    packed = data[q : q + (n_seq + 1) // 2]
    q += (n_seq + 1) // 2
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq]
    span = sum(o >> 4 for o in ops if o & 15 in (0, 2, 3, 7, 8))
    at = lambda i: refs[i][0] if i >= 0 else None
    return name, flag, at(ref), pos, mapq, "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops), span, at(mate), mate_pos, tlen, seq, data[q : q + n_seq], _tag(data, q + n_seq, p + size, b"MD")


def _plausible(data: bytes, p: int, n_refs: int) -> bool:
    if p + 36 > len(data):
        return False
    size, ref, pos, n_name = struct.unpack_from("<iiiB", data, p)
    _, n_cigar, _, n_seq, mate = struct.unpack_from("<HHHii", data, p + 14)
    return 32 < size < 1 << 24 and -1 <= ref < n_refs and pos >= -1 and n_name > 1 and -1 <= mate < n_refs and 0 <= n_seq < 1 << 24 and 32 + n_name + 4 * n_cigar + n_seq + (n_seq + 1) // 2 <= size and data[p + 36 + n_name - 1 : p + 36 + n_name] == b"\0"


def _first_record(data: bytes, n_refs: int) -> int:
    """Offset of the first record that begins in the data: one that is followed by further plausible ones."""
    for p in range(len(data)):
        q, k = p, 0
        while k < 4 and _plausible(data, q, n_refs):
            q, k = q + 4 + struct.unpack_from("<i", data, q)[0], k + 1
        if k == 4 or (k and q == len(data)) or (k and q + 36 > len(data)):
            return p
    return len(data)


def region_chunks(index_path: str, ref: int, start: int, end: int) -> list[tuple[int, int]]:
    """Virtual offset ranges of an index's bins that may overlap ``[start, end)``, cut by its linear index, joined."""
    wanted = {0}
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        wanted |= set(range(first + (start >> shift), first + ((end - 1) >> shift) + 1))
    with open(index_path, "rb") as f:
        data = f.read()
    p, out, least = 8, [], 0
    for r in range(struct.unpack_from("<i", data, 4)[0]):
        n_bin, p = struct.unpack_from("<i", data, p)[0], p + 4
        for _ in range(n_bin):
            b, n = struct.unpack_from("<Ii", data, p)
            p += 8
            if r == ref and b in wanted:
                out += [struct.unpack_from("<QQ", data, p + 16 * k) for k in range(n)]
            p += 16 * n
        n_intv, p = struct.unpack_from("<i", data, p)[0], p + 4
        if r == ref and n_intv:
            least = struct.unpack_from("<Q", data, p + 8 * min(start >> 14, n_intv - 1))[0]
        p += 8 * n_intv
    merged: list[tuple[int, int]] = []
    for a, b in sorted((max(a, least), b) for a, b in out if b > least):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


class Split(InputPartition):
    def __init__(self, path: str, start: int, stop: int, within: int | None, refs: list):
        self.path, self.start, self.stop, self.within, self.refs = path, start, stop, within, refs


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        path = self.options["path"].removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.bam"))) if os.path.isdir(path) else sorted(glob.glob(path))
        step, out = int(self.options.get("split_bytes", 64 << 20)), []
        for p in files:
            refs, block, within = header(p)
            size = os.path.getsize(p)
            if self.options.get("region") and os.path.exists(p + ".bai"):
                chrom, _, span = self.options["region"].rpartition(":")
                a, b = map(int, span.split("-"))
                ref = [n for n, _ in refs].index(chrom)
                out += [Split(p, s >> 16, (e >> 16) + 1, s & 0xFFFF, refs) for s, e in region_chunks(p + ".bai", ref, a, b)]
                continue
            out.append(Split(p, block, min(size, block + step), within, refs))
            out += [Split(p, at, min(size, at + step), None, refs) for at in range(block + step, size, step)]
        return out

    def read(self, split):
        size = os.path.getsize(split.path)
        with open(split.path, "rb") as f:
            start = split.start if split.within is not None else _next_block(f, split.start, size)
            stop = split.stop
            if start >= stop:
                return
            data, p, edge, first = b"", split.within, None, True
            for at, d in blocks(f, start, size):
                if at >= stop and edge is None:
                    edge = len(data) - 0
                data += d
                if first:
                    first = False
                    p = p if p is not None else _first_record(data, len(split.refs))
                while p + 4 <= len(data) and (edge is None or p < edge):
                    n = struct.unpack_from("<i", data, p)[0]
                    if p + 4 + n > len(data):
                        break
                    yield record(data, p + 4, split.refs)
                    p += 4 + n
                if edge is not None and p >= edge:
                    return
                if edge is not None:
                    edge -= p
                data, p = data[p:], 0


class BamSource(DataSource):
    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)


def tags(reads: DataFrame) -> DataFrame:
    """Tags at the 5' ends of usable reads."""
    rows = reads.where(usable(F.col("flag")) & F.col("chrom").isNotNull())
    strand = F.when(F.col("flag").bitwiseAND(16) != 0, 1).otherwise(0)
    return rows.select("chrom", F.when(strand == 0, F.col("pos")).otherwise(F.col("pos") + F.col("ref_len")).alias("pos"), strand.alias("strand"))


def fragments(reads: DataFrame) -> DataFrame:
    """Fragments of properly paired reads, one per pair."""
    rows = reads.where(usable(F.col("flag")) & (F.col("flag").bitwiseAND(1) != 0) & F.col("chrom").isNotNull() & (F.col("tlen") != 0))
    left = F.least("pos", "mate_pos")
    return rows.select("chrom", left.alias("l"), (left + F.abs("tlen")).alias("r"))


def in_region(reads: DataFrame, chrom: str, start: int, end: int, most_equal: int = 1) -> DataFrame:
    """Reads that overlap the region, with a mapping quality of 1 to 254 and an MD tag, at most so many of equal place and strand."""
    from pyspark.sql import Window

    rows = reads.where((F.col("chrom") == chrom) & (F.col("pos") < end) & (F.col("pos") + F.col("ref_len") > start) & F.col("mapq").between(1, 254) & F.col("md").isNotNull())
    w = Window.partitionBy("chrom", "pos", "ref_len", F.col("flag").bitwiseAND(16)).orderBy("name")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most_equal).drop("_n")
