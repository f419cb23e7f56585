"""Every row of a table together with the one that follows it by key, without a global sort.

A stored table of keys (no texts) gives borders that deal the rows, in order, to
buckets of bounded size, and each bucket's first key. Texts then travel once,
compressed, each to its bucket, and a bucket's first text also to the end of the
bucket before. A bucket is sorted by Spark and read once from begin to end.
"""

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procsight.llm.tables import drop, new_path, written

#: Bytes of text in a bucket, about; keys looked at for each border; buckets for each shuffle partition at least.
BUCKET_BYTES, PER_BORDER, SPREAD = 8 << 20, 30, 2
#: Bytes of compressed text that are judged together.
PIECE = 1 << 20



def _place(key: int | None, h: int) -> tuple[int, int, int]:
    return (0, 0, h) if key is None else (1, key, h)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Neighbours:
    """Rows (doc_id bigint, text binary) in the order of doc_id, nulls first, then of the text's hash."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.withColumn("h", F.xxhash64("text"))
        spark = rows.sparkSession
        path = new_path(spark, "keys")
        keys = written(self.rows.select("doc_id", "h", F.octet_length("text").alias("size")), path)
        n, size = keys.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.buckets = max(1, min(n, max(SPREAD * _partitions(spark), size // BUCKET_BYTES)))
        self.borders = self._borders(keys, n)
        self.firsts = self._firsts(keys)
        drop(spark, path)

    def _borders(self, keys: DataFrame, n: int) -> list[tuple[int, int, int]]:
        """The least place of every bucket but the first, from a bounded sample of keys: PER_BORDER for each bucket."""
        if self.buckets < 2:
            return []
        rate = min(1.0, PER_BORDER * self.buckets / n)
        drawn = keys.where(F.pmod(F.xxhash64(F.lit("border"), "doc_id", "h"), F.lit(1 << 30)) < int(rate * (1 << 30))).select("doc_id", "h")
        places = sorted(_place(k, h) for k, h in drawn.collect())
        at = [places[len(places) * i // self.buckets] for i in range(1, self.buckets)] if places else []
        return sorted(set(at))

    def _firsts(self, keys: DataFrame) -> dict[int, tuple[tuple[int, int, int], int]]:
        """For each bucket that has rows its first place, and the bucket before it (for the first bucket the last one)."""
        borders = self.borders

        def least(batches):
            found: dict[int, tuple] = {}
            for batch in batches:
                for key, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    place = _place(key, h)
                    b = bisect_right(borders, place)
                    if b not in found or place < found[b]:
                        found[b] = place
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array(list(found), pa.int32())}
                | {name: pa.array([p[i] for p in found.values()], pa.int64()) for i, name in enumerate(("there", "key", "h"))}
            )

        each = keys.select("doc_id", "h").mapInArrow(least, "bucket int, there bigint, key bigint, h bigint")
        rows = each.groupBy("bucket").agg(F.min(F.struct("there", "key", "h")).alias("place")).collect()
        places = {r.bucket: tuple(r.place) for r in sorted(rows)}
        order = list(places)
        return {b: (place, order[i - 1]) for i, (b, place) in enumerate(places.items())}

    def dealt(self) -> DataFrame:
        """bucket, last, doc_id, h, zipped, sorted within each bucket; `last` marks the text that follows a bucket's last row."""
        borders, firsts = self.borders, self.firsts

        def deal(batches):
            pack = zstandard.ZstdCompressor(level=3).compress
            for batch in batches:
                out: list[tuple] = []
                size = 0
                for key, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    place = _place(key, h)
                    b = bisect_right(borders, place)
                    zipped = pack(text)
                    out.append((b, False, key, h, zipped))
                    first, before = firsts[b]
                    if place == first:
                        out.append((before, True, key, h, zipped))
                    size += len(zipped)
                    if size > PIECE:
                        yield _batch(out)
                        out, size = [], 0
                if out:
                    yield _batch(out)

        kind = "bucket int, last boolean, doc_id bigint, h bigint, zipped binary"
        rows = self.rows.select("doc_id", "h", "text").mapInArrow(deal, kind)
        dealt = rows.repartition(min(self.buckets, _partitions(rows.sparkSession)), "bucket")
        return dealt.sortWithinPartitions("bucket", "last", F.col("doc_id").asc_nulls_first(), "h")

    def judged(self, judge: Callable[[list, list[bytes], list[bytes]], pa.RecordBatch], schema: str) -> DataFrame:
        """What `judge` makes of keys, texts and following texts, for some rows at a time; each row comes up once."""

        def read(batches):
            unpack = zstandard.ZstdDecompressor().decompress
            ids, texts, following = [], [], []
            held: tuple | None = None
            size = 0
            for bucket, last, key, zipped in _rows(batches):
                if held is None and last:
                    # Equal first rows are sent several times; the first one is enough.
                    continue
                text = unpack(zipped)
                if held is not None:
                    ids.append(held[1])
                    texts.append(held[2])
                    following.append(text)
                    size += len(text)
                held = None if last else (bucket, key, text)
                if size > PIECE * 2:
                    yield judge(ids, texts, following)
                    ids, texts, following, size = [], [], [], 0
            if ids:
                yield judge(ids, texts, following)

        return self.dealt().mapInArrow(read, schema)


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        columns = [batch.column(i) for i in (0, 1, 2, 4)]
        for i in range(len(batch)):
            yield tuple(c[i].as_py() for c in columns)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "last", "doc_id", "h", "zipped"])
