"""Large JSON array files, read by many tasks.

A file that holds one array of objects has no line per record, so a plain reader gives it to
one task. Here the file is cut after every closing brace, which Spark can do in every part of
a file by itself. Whether a brace stands in a string, and how deep it is nested, depends on all
that comes before it. So the files are read twice, each part in order by the task that reads it.
First every part is summed up as what it does to that state; running totals over these sums
(one small row per part) give the state in which each part begins. Then the parts are cut. A
record ends at a brace outside of strings that brings the depth back to 0.

No text is shuffled but what stands before a part's first end and after its last: a record over
several parts is put together from these. The records are stored, with zstd, and read from there.

Between records only blanks, commas and the array's brackets may stand. Records may span
parts of the file. Braces, quotes and backslashes inside strings are read as text. Empty
files and empty arrays give no records. Compressed files cannot be cut: one task reads each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from respeval.functions.once import computed_once
from respeval.session import work_dir

#: Bytes of pieces that are looked at together.
CHUNK = 1 << 23

_QUOTE, _OPEN, _CLOSE, _ESCAPE = b'"{}\\'
_MARK = np.zeros(256, dtype=bool)
_MARK[[_QUOTE, _OPEN, _CLOSE]] = True
_STEP = np.zeros(256, dtype=np.int64)
_STEP[_OPEN], _STEP[_CLOSE] = 1, -1

_EFFECTS = "file string, part long, odd long, depth_0 long, depth_1 long"
# Whole records have no file. Of the others ``at`` is 0 for what a part begins with, 1 for its rest.
_CUT = "file string, part long, at int, ends boolean, record string"
_Starts = dict[str, dict[int, tuple[int, int]]]


def _same_parts(spark: SparkSession) -> SparkSession:
    """A session like this one in which files are cut the same way every time: otherwise the size
    of parts follows the number of cores there are at the moment."""
    session = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    if not session.conf.get("spark.sql.files.minPartitionNum", None):
        cores = session.conf.get("spark.sql.leafNodeDefaultParallelism", None)
        session.conf.set("spark.sql.files.minPartitionNum", cores or spark.sparkContext.defaultParallelism)
    return session


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the files up to a closing brace, with ``file`` and ``part``; a part's in order."""
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.concat("value", F.lit("}")).alias("piece"),
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], np.ndarray, pa.Buffer]]:
    """Pieces of one part that follow each other: file and part, their borders, the bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        pieces = batch.column("piece").cast(pa.string())
        borders = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        files, parts = batch.column("file").dictionary_encode(), batch.column("part").to_numpy()
        kinds = files.indices.to_numpy()
        turns = np.flatnonzero((kinds[1:] != kinds[:-1]) | (parts[1:] != parts[:-1])) + 1
        for first, last in zip([0, *turns.tolist()], [*turns.tolist(), len(pieces)], strict=True):
            key = (files.dictionary[int(kinds[first])].as_py(), int(parts[first]))
            while first < last:
                most = int(np.searchsorted(borders, int(borders[first]) + CHUNK, "right")) - 1
                upto = min(max(most, first + 1), last)
                yield key, borders[first : upto + 1].astype(np.int64), pieces.buffers()[2]
                first = upto


def _effects(borders: np.ndarray, data: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """After each piece, from the first one's beginning on: the quotes, and the change of depth if
    it begins outside, and inside, of a string."""
    text = np.frombuffer(data, np.uint8)[borders[0] : borders[-1]]
    at = np.flatnonzero(_MARK[text])
    # An escape cannot reach over the end of a piece: no escape has a brace.
    slashed = np.flatnonzero((at > 0) & (text[at - 1] == _ESCAPE))
    if len(slashed):
        slashes = np.flatnonzero(text == _ESCAPE)
        ends = np.flatnonzero(np.append(np.diff(slashes) > 1, True))
        length = np.diff(ends, prepend=-1)
        escaped = length[np.searchsorted(slashes[ends], at[slashed] - 1)] % 2 == 1
        at = np.delete(at, slashed[escaped])
    kind = text[at]
    turns, step = np.cumsum(kind == _QUOTE), _STEP[kind]
    upto = np.searchsorted(at, borders[1:] - borders[0])
    outside, inside = (np.cumsum(np.where(turns % 2 == state, step, 0)) for state in (0, 1))
    return tuple(np.append(0, total)[upto] for total in (turns, outside, inside))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``odd``: whether a part changes between string and no string; by how much it changes the depth
    if it begins outside (0) or inside (1) of a string."""
    sums: list[list] = []
    for key, borders, data in _runs(batches):
        if not sums or (sums[-1][0], sums[-1][1]) != key:
            sums.append([*key, 0, 0, 0])
        quotes, *deeper = _effects(borders, data)
        now = sums[-1]
        for state in (0, 1):
            now[3 + state] += int(deeper[(now[2] + state) % 2][-1])
        now[2] = (now[2] + int(quotes[-1])) % 2
    if sums:
        names = ("file", "part", "odd", "depth_0", "depth_1")
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*sums, strict=True)), strict=True)))


def _strings(borders: np.ndarray, data: pa.Buffer) -> pa.Array:
    return pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders.astype(np.int32)), data)


def _rows(records: pa.Array, key: tuple[str | None, int | None] = (None, None), at: int | None = None) -> pa.RecordBatch:
    """Whole records, or with a key what stands before a part's first end (``at`` 0) or after its last (1)."""
    n, ends = len(records), None if at is None else at == 0
    columns = zip((*key, at, ends), (pa.string(), pa.int64(), pa.int32(), pa.bool_()), strict=True)
    names = ["file", "part", "at", "ends", "record"]
    return pa.RecordBatch.from_arrays([*(pa.array([v] * n, kind) for v, kind in columns), records], names)


def _cut(starts: _Starts) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of parts that begin in the given state (1: inside a string) and depth."""

    def one(texts: list[bytes]) -> pa.Array:
        text = b"".join(texts)
        return _strings(np.array([0, len(text)]), pa.py_buffer(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, begun, rest = None, False, []
        for at, borders, data in _runs(batches):
            if at != key:
                if rest:
                    yield _rows(one(rest), key, 1)
                # A record may be open when a part begins that is not a file's first.
                key, begun, rest = at, at[1] > 0, []
                if at[1] not in starts.get(at[0], {}):
                    raise RuntimeError(f"{at[0]} was cut at other places when it was read first")
                state, base = starts[at[0]][at[1]]
            quotes, *deeper = _effects(borders, data)
            depth, state_after = base + deeper[state], (state + quotes) % 2
            ends = np.flatnonzero((state_after == 0) & (depth == 0)) + 1
            base, state = int(depth[-1]), int(state_after[-1])
            text, done = memoryview(data), int(borders[0])
            if len(ends) and (rest or begun):
                rest.append(bytes(text[done : borders[ends[0]]]))
                yield _rows(one(rest), key, 0) if begun else _rows(one(rest))
                begun, rest, done = False, [], int(borders[ends[0]])
            if len(ends):
                whole = np.unique([done, *borders[ends].tolist()])
                if len(whole) > 1:
                    yield _rows(_strings(whole, data))
                done = int(whole[-1])
            if done < borders[-1]:
                rest.append(bytes(text[done : borders[-1]]))
        if rest:
            yield _rows(one(rest), key, 1)

    return run


def _before(column: Column, over) -> Column:
    """The sum of all rows before this one."""
    return F.coalesce(F.sum(column).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _starts(pieces: DataFrame) -> _Starts:
    """In which state and depth each part begins: one row per part, known to the driver as the parts are."""
    across = Window.partitionBy("file").orderBy("part")
    parts = pieces.mapInArrow(_summed, _EFFECTS).withColumn("state", _before(F.col("odd"), across) % 2)
    gained = F.when(F.col("state") == 0, F.col("depth_0")).otherwise(F.col("depth_1"))
    starts: _Starts = {}
    for row in parts.select("file", "part", "state", _before(gained, across).alias("base")).collect():
        starts.setdefault(row["file"], {})[row["part"]] = (row["state"], row["base"])
    return starts


def array_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of every object of the array files at ``path``, stored when this is called."""
    pieces = _pieces(_same_parts(spark), path)
    # Nothing but the pieces' columns may stand between scan and function: a part's rows stay in order.
    cut = pieces.mapInArrow(_cut(_starts(pieces)), _CUT)
    bare = F.regexp_replace("record", r"^[\s,\[\x{FEFF}]+", "")
    cut = cut.withColumn("record", F.when(F.col("file").isNull(), bare).otherwise(F.col("record")))
    folder = work_dir(spark, "records")
    cut.write.option("compression", "zstd").parquet(folder)
    cut = spark.read.schema(_CUT).parquet(folder)
    # What is left of a part is numbered by the ends before it in the file.
    across = Window.partitionBy("file").orderBy("part", "at")
    left = cut.where("file IS NOT NULL").withColumn("number", _before(F.col("ends").cast("int"), across))
    joined = left.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("part", "at", "record"))).alias("pieces"), F.max("ends").alias("whole")
    )
    joined = joined.where("whole").select(F.array_join("pieces.record", "").alias("record")).select(bare.alias("record"))
    return cut.where("file IS NULL").select("record").union(joined)


def parsed_records(records: DataFrame, schema: StructType) -> DataFrame:
    """The fields of ``schema`` of each ``record``."""
    row = F.from_json("record", schema)
    return computed_once(records, {"row": row}, keep=[]).select("row.*")
