"""Driving-dataset files as Spark data sources: lidar sweeps, coloured clouds and record tables.

    spark.dataSource.register(formats.Sweeps)   # register() does all of them
    spark.read.format("lidar_sweeps").load(folder)
    rows.write.format("lidar_sweeps").save(folder)

Millions of small sweeps go into packs (packed_sweeps): Parquet files of rows that hold a sweep file's name and bytes.

A folder's files are dealt to partitions in groups of about GROUP_BYTES (option group_bytes), so many small files are few tasks. What a reader's
schema leaves out isn't built (read.schema("frame string, x float")). Writers write each frame's file under a name of the
attempt and rename it when the job commits, so neither retries nor failed jobs leave half a folder. Paths are addresses that
pyarrow's file systems know (file://, hdfs://, s3://).
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.checks import required
from ..operators.grouped import starts, whole_groups
from ..session import on_workers, shuffles_freed

#: Bytes of files that one partition reads, about, and points of an Arrow batch.
GROUP_BYTES, BATCH_ROWS = 32 << 20, 1 << 16
#: Numbers of a stored lidar point, little-endian 32-bit floats (fixed).
POINT = ("x", "y", "z", "intensity", "ring")
#: A packed sweep: its file's name and bytes.
PACK = "filename string, content binary"


@dataclass
class Files(InputPartition):
    """Some files of a folder, by path and their number in name order."""

    paths: list[str]
    first: int


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (name of the attempt, final name)."""

    moves: list[tuple[str, str]]


def _system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], ending: str, schema: StructType) -> None:
        self.path, self.ending, self.names = options["path"], ending, schema.names
        self.group_bytes = int(options.get("group_bytes", GROUP_BYTES))

    def partitions(self) -> list[Files]:
        fs, place = _system(self.path)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(place, recursive=True)) if f.is_file and f.path.endswith(self.ending) and not f.base_name.startswith(("_", ".")))
        out, own, size, first = [], [], 0, 0
        for k, (path, n) in enumerate(found):
            if own and size + n > self.group_bytes:
                out.append(Files(own, first))
                own, size, first = [], 0, k
            own.append(path)
            size += n
        return [*out, Files(own, first)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _system(self.path)
        for k, path in enumerate(partition.paths):
            with fs.open_input_stream(path) as f:
                raw = f.read()
            yield from self.rows(path, partition.first + k, raw)

    def rows(self, path: str, number: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def columns(self, n: int, made: dict[str, object]) -> pa.RecordBatch:
        """A batch of the columns that the schema asks for; `made` gives each as a function, so others aren't built."""
        unknown = [c for c in self.names if c not in made]
        if unknown:
            raise ValueError(f"files of this format have no {', '.join(unknown)}; they have {', '.join(made)}")
        return pa.RecordBatch.from_arrays([made[c]() for c in self.names], names=self.names)


class _FileWriter(DataSourceArrowWriter):
    """A file for each frame: rows arrive with a frame's together and in order (see by_frame)."""

    def __init__(self, path: str, ending: str, key: str, overwrite: bool) -> None:
        self.path, self.ending, self.key, self.overwrite, self.job = path, ending, key, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, place = _system(self.path)
        work = f"{place}/_work-{self.job}"
        fs.create_dir(work, recursive=True)
        moves = []
        for batch in whole_groups(iterator, [self.key]):
            edges = [*starts(batch, [self.key]).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                own = batch.slice(a, b - a)
                temp = f"{work}/{uuid.uuid4().hex}"
                with fs.open_output_stream(temp) as f:
                    f.write(self.encoded(own))
                moves.append((temp, f"{place}/{self.name(own.column(self.key)[0].as_py())}{self.ending}"))
        return Written(moves)

    def name(self, value: object) -> str:
        if value is None or "/" in str(value):
            raise ValueError("a frame's name is not null and has no slash")
        return str(value)

    def encoded(self, rows: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def commit(self, messages: list[Written | None]) -> None:
        fs, place = _system(self.path)
        moves = [m for w in messages if w is not None for m in w.moves]
        names = [final for _, final in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a frame's rows were in two tasks; deal them with by_frame")
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(place, allow_not_found=True)):
                if f.is_file and f.path.endswith(self.ending):
                    fs.delete_file(f.path)
        for temp, final in moves:
            fs.move(temp, final)
        fs.create_dir(f"{place}/_work-{self.job}", recursive=True)  # a job without tasks made none
        fs.delete_dir(f"{place}/_work-{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, place = _system(self.path)
        if fs.get_file_info(f"{place}/_work-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{place}/_work-{self.job}")


def by_frame(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows as file writers want them: a frame in one task, in the order of its points."""
    return rows.repartition(key).sortWithinPartitions(key, order)


class _Points(_Reader):
    def rows(self, path: str, number: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        if len(raw) % (4 * len(POINT)):
            raise ValueError(f"{path} ends inside a point")
        table = np.frombuffer(raw, "<f4").reshape(-1, len(POINT))
        frame = path.rsplit("/", 1)[-1].removesuffix(self.ending)
        for a in range(0, len(table), BATCH_ROWS):
            own = table[a : a + BATCH_ROWS]
            made = {c: (lambda j=j: pa.array(np.ascontiguousarray(own[:, j]))) for j, c in enumerate(POINT)}  # noqa: B023
            made |= {"frame": lambda: pa.repeat(pa.scalar(frame), len(own)), "point_idx": lambda: pa.array(np.arange(a, a + len(own), dtype=np.int32))}  # noqa: B023
            yield self.columns(len(own), made)


def _files_of(records: DataFrame, folder: str, column: str, keys: list[str], schema: str, make: Callable[[str, bytes], Iterator[pa.RecordBatch]]) -> DataFrame:
    """keys of each record, and what `make` gives of its file (folder/column). A missing file is an error; a null name has no rows.

    Tasks open the files of their records, so only those asked for are read and nothing is joined; a file at a time is held.
    """
    on_workers(records.sparkSession)
    wanted = records.where(F.col(column).isNotNull()).select(column, *keys)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _system(folder)
        for batch in batches:
            for k, name in enumerate(batch.column(0).to_pylist()):
                with fs.open_input_stream(f"{top}/{name}") as f:
                    raw = f.read()
                for rows in make(name, raw):
                    own = [pa.repeat(batch.column(c)[k], rows.num_rows) for c in keys]
                    yield pa.RecordBatch.from_arrays([*own, *rows.columns], names=[*keys, *rows.schema.names])

    types = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in keys)
    # A record is some bytes and its file a thousand times as many, so records are dealt anew.
    return wanted.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(read, f"{types}, {schema}")


def points_of(records: DataFrame, folder: str, keys: list[str], column: str = "filename") -> DataFrame:
    """Lidar points of the records' own sweep files: keys, point_idx, x, y, z, intensity, ring."""
    schema = "point_idx int, x float, y float, z float, intensity float, ring float"
    names = StructType.fromDDL(schema)
    return _files_of(records, folder, column, keys, schema, lambda name, raw: _Points({"path": folder}, "", names).rows(name, 0, raw))


def contents_of(records: DataFrame, folder: str, keys: list[str], column: str = "filename") -> DataFrame:
    """The records' own files as bytes, for a predictor to decode: keys, content."""
    return _files_of(records, folder, column, keys, "content binary", lambda name, raw: iter([pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["content"])]))


def packed_sweeps(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Sweeps as the bytes of their .bin files, a row each (filename, content), in Parquet files of many; returns them.

    Rows arrive as by_frame deals them. A file of its own for each of millions of small sweeps takes a block of disk, a
    rename and a place in the driver's list; here tasks write rows, and the driver knows a few files.
    """
    on_workers(rows.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, [key]):
            first = starts(batch, [key])
            frames = batch.column(key).take(pa.array(first))
            if any(f is None or "/" in f for f in frames.to_pylist()):
                raise ValueError("a frame's name is not null and has no slash")
            raw = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype("<f4") for c in POINT])
            edges = np.append(first, batch.num_rows).astype(np.int64) * (4 * len(POINT))
            content = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(frames, ".bin", ""), content.cast(pa.binary())], names=["filename", "content"])

    rows.mapInArrow(pack, PACK).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(PACK).parquet(path)


def unpacked_points(packs: DataFrame, keys: list[str]) -> DataFrame:
    """keys of each row, and the points of its content: point_idx, x, y, z, intensity, ring. A sweep that ends inside a point is an error."""
    on_workers(packs.sparkSession)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if (sizes % (4 * len(POINT))).any():
                broken = batch.column("filename")[int(np.flatnonzero(sizes % (4 * len(POINT)))[0])]
                raise ValueError(f"{broken} ends inside a point")
            own = np.repeat(np.arange(len(sizes)), sizes // (4 * len(POINT)))
            table = np.frombuffer(b"".join(c for c in batch.column("content").to_pylist() if c), "<f4").reshape(-1, len(POINT))
            nth = np.arange(len(own)) - np.searchsorted(own, own)
            for a in range(0, len(own), BATCH_ROWS):
                part, at = slice(a, a + BATCH_ROWS), pa.array(own[a : a + BATCH_ROWS])
                columns = [*(batch.column(k).take(at) for k in keys), pa.array(nth[part].astype(np.int32)), *(pa.array(np.ascontiguousarray(table[part, j])) for j in range(len(POINT)))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "point_idx", *POINT])

    types = ", ".join(f"{k} {packs.schema[k].dataType.simpleString()}" for k in keys)
    return packs.select(*dict.fromkeys([*keys, "filename", "content"])).mapInArrow(unpack, f"{types}, point_idx int, " + ", ".join(f"{c} float" for c in POINT))


def packed_points(packs: DataFrame) -> DataFrame:
    """The points of all packed sweeps, as the sweep format gives those of a folder: frame, point_idx, x, y, z, intensity, ring."""
    return unpacked_points(packs.withColumn("frame", F.regexp_replace("filename", r"\.bin$", "")), ["frame"])


def points_in(records: DataFrame, packs: DataFrame, keys: list[str], column: str = "filename") -> DataFrame:
    """Lidar points of the records' own sweeps among packed ones: as points_of. A missing sweep is an error; a null name has no rows."""
    wanted = records.where(F.col(column).isNotNull()).select(F.col(column).alias("filename"), *(k for k in keys if k != "filename"))
    found = wanted.join(packs.withColumn("_there", F.lit(True)), "filename", "left")
    return unpacked_points(required(found, {"_there": ("sweep", "filename")}, "filename"), keys)


class _PointsWriter(_FileWriter):
    def encoded(self, rows: pa.RecordBatch) -> bytes:
        return np.column_stack([rows.column(c).to_numpy(zero_copy_only=False).astype("<f4") for c in POINT]).tobytes()


class Sweeps(DataSource):
    """Folders of .bin files, one a sweep, of points x, y, z, intensity, ring. A file that ends inside a point is an error."""

    @classmethod
    def name(cls) -> str:
        return "lidar_sweeps"

    def schema(self) -> str:
        return "frame string, point_idx int, x float, y float, z float, intensity float, ring float"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Points(self.options, ".bin", schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _PointsWriter(self.options["path"], ".bin", "frame", overwrite)


class _Cloud(_Reader):
    def rows(self, path: str, number: int, raw: bytes) -> Iterator[pa.RecordBatch]:
        head, _, body = raw.partition(b"end_header\n")
        lines = head.decode("ascii").split("\n")
        if lines[:2] != ["ply", "format ascii 1.0"] or not any(x.startswith("element vertex ") for x in lines):
            raise ValueError(f"{path} is no ASCII cloud")
        count = int(next(x for x in lines if x.startswith("element vertex ")).split()[2])
        fields = [x.split()[2] for x in lines if x.startswith("property ")]
        table = np.array(body.split(), "S").astype(float).reshape(-1, len(fields)) if fields else np.zeros((0, 0))
        if len(table) != count:
            raise ValueError(f"{path} has {len(table)} points, its header {count}")
        frame = path.rsplit("/", 1)[-1].removesuffix(self.ending)
        at = {c: j for j, c in enumerate(fields)}
        shade = {c: (lambda c=c: pa.array(table[:, at[c]] / 255)) for c in ("red", "green", "blue") if c in at}
        made = {c: (lambda c=c: pa.array(table[:, at[c]])) for c in "xyz"} | shade
        made |= {"frame": lambda: pa.repeat(pa.scalar(frame), count), "point_idx": lambda: pa.array(np.arange(count, dtype=np.int32))}
        yield self.columns(count, made)


class _CloudWriter(_FileWriter):
    def name(self, value: object) -> str:
        return f"point{value:04d}" if isinstance(value, int) else super().name(value)

    def encoded(self, rows: pa.RecordBatch) -> bytes:
        fields = "".join(f"property double {c}\n" for c in "xyz") + "".join(f"property uchar {c}\n" for c in ("red", "green", "blue"))
        xyz = [rows.column(c).to_pylist() for c in "xyz"]
        shade = [np.rint(rows.column(c).to_numpy(zero_copy_only=False) * 255).astype(int).tolist() for c in ("red", "green", "blue")]
        lines = [f"{x!r} {y!r} {z!r} {r} {g} {b}\n" for x, y, z, r, g, b in zip(*xyz, *shade, strict=True)]
        return f"ply\nformat ascii 1.0\nelement vertex {rows.num_rows}\n{fields}end_header\n{''.join(lines)}".encode("ascii")


class Clouds(DataSource):
    """Folders of ASCII .ply files, one a frame (whole numbers are named point0000, ...), of points with colours from 0 to 1."""

    @classmethod
    def name(cls) -> str:
        return "ply_clouds"

    def schema(self) -> str:
        return "frame string, point_idx int, x double, y double, z double, red double, green double, blue double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Cloud(self.options, ".ply", schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _CloudWriter(self.options["path"], ".ply", "frame_idx", overwrite)


class _RecordsWriter(_FileWriter):
    """Compressed JSON arrays of up to per_file records, which come as JSON text: a task writes them as they come and holds a batch."""

    def __init__(self, path: str, overwrite: bool, per_file: int) -> None:
        super().__init__(path, ".json.gz", "record", overwrite)
        self.per_file = per_file

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, place = _system(self.path)
        work = f"{place}/_work-{self.job}"
        fs.create_dir(work, recursive=True)
        moves, file, out, n = [], None, None, 0

        def close() -> None:
            out.write(b"]")
            out.close()
            file.close()

        for batch in iterator:
            records = batch.column(0)
            a = 0
            while a < len(records):
                if out is None:
                    name = uuid.uuid4().hex
                    moves.append((f"{work}/{name}", f"{place}/{name}{self.ending}"))
                    file, n = fs.open_output_stream(f"{work}/{name}", compression=None), 0
                    out = gzip.GzipFile(fileobj=file, mode="wb", compresslevel=1)
                own = records.slice(a, self.per_file - n)
                out.write((",\n" if n else "[").encode() + ",\n".join(own.to_pylist()).encode())
                a, n = a + len(own), n + len(own)
                if n == self.per_file:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(moves)


class Records(DataSource):
    """Writes records (one column, JSON text) as files of JSON arrays; readers.read_table reads them with their declared schemas.

    Option: per_file, the most records of a file.
    """

    @classmethod
    def name(cls) -> str:
        return "json_records"

    def schema(self) -> str:
        raise ValueError("record tables are read with readers.read_table")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _RecordsWriter(self.options["path"], overwrite, int(self.options.get("per_file", 50_000)))


class _Listed(_Reader):
    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _system(self.path)
        for k, path in enumerate(partition.paths):
            made = {"nth": lambda k=k: pa.array([partition.first + k], pa.int64()), "path": lambda path=path: pa.array([path]), "filename": lambda path=path: pa.array([path.rsplit("/", 1)[-1]])}
            if "content" in self.names:
                with fs.open_input_stream(path) as f:
                    raw = f.read()
                made["content"] = lambda raw=raw: pa.array([raw], pa.binary())
            yield self.columns(1, made)


class Images(DataSource):
    """Folders of image files, numbered in name order from 0; bytes stay as they are, and aren't read where they aren't asked for.

    Numbers come from the listing that deals files to partitions, so nothing is sorted or joined. Option: ending (.png).
    """

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def schema(self) -> str:
        return "nth long, path string, filename string, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Listed(self.options, self.options.get("ending", ".png"), schema)


def register(spark: SparkSession) -> None:
    """Make all formats known to a session, and the package to its workers."""
    on_workers(spark)
    for source in (Sweeps, Clouds, Records, Images):
        spark.dataSource.register(source)


def compacted(points: DataFrame, out: str, rows_per_file: int = 5_000_000) -> DataFrame:
    """The points of many small sweeps as even Parquet files, sorted by frame, so that a frame's points are read from one place; returns them."""
    n = max(1, -(-points.count() // rows_per_file))
    points.repartitionByRange(n, "frame", "point_idx").sortWithinPartitions("frame", "point_idx").write.mode("overwrite").parquet(out)
    return points.sparkSession.read.schema(points.schema).parquet(out)


def bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str) -> DataFrame:
    """The rows as a table dealt and sorted by a key into buckets: joins of two such tables on it need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def record_files(df: DataFrame, path: str, per_file: int = 50_000) -> None:
    """A record table as compressed JSON arrays of up to per_file records each, below path.

    Spark makes the JSON where the rows lie, once: nothing is counted or moved, and files take about a tenth of their text.
    """
    register(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        df.select(F.to_json(F.struct(*df.columns)).alias("record")).write.format("json_records").option("per_file", per_file).mode("overwrite").save(path)


def remove_folder(path: str) -> None:
    """Delete a folder of files that were stored on the way to others."""
    fs, place = _system(path)
    fs.delete_dir(place)
