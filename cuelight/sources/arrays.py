"""Vectors in array files (.npy), one matrix per video, as a data source.

``spark.read.format("array_vectors").load(path)`` gives video_id, pos,
embedding. Files are found by a listing and cut by their size: a large file
becomes several tasks, small ones share a task. Filters on video_id prune
files before anything is opened.
"""

from __future__ import annotations

import io
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: bytes of one task and rows of one batch
TASK_BYTES, BATCH_ROWS = 64 << 20, 2048


def file_system(path: str):
    """(file system, path on it) of a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:/"):  # Hadoop writes one slash or three
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Pieces(InputPartition):
    """Parts ``no`` of ``parts`` of files: (path, video_id, no, parts)."""

    def __init__(self, files: list[tuple[str, str, int, int]]):
        super().__init__(files)


class ArrayVectors(DataSource):
    """Options: path (a folder of <video_id>.npy or of <video_id>/<first pos>.npy)."""

    @classmethod
    def name(cls) -> str:
        return "array_vectors"

    def schema(self) -> str:
        return "video_id string, pos bigint, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return ArrayReader(self.options["path"])


class ArrayReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.videos = path, None

    def pushFilters(self, filters):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("video_id",):
                yield f
            else:
                self.videos = values if self.videos is None else self.videos & values

    def partitions(self) -> list[Pieces]:
        from pyarrow import fs

        system, root = file_system(self.path)
        pieces, held, size = [], [], 0
        for f in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda f: f.path):
            inner = f.path[len(root.rstrip("/")) + 1 :]
            if f.type != fs.FileType.File or not inner.endswith(".npy"):
                continue
            video = inner.split("/")[0].removesuffix(".npy")
            if self.videos is not None and video not in self.videos:
                continue
            parts = max(1, -(-f.size // TASK_BYTES))
            for no in range(parts):
                if held and size + f.size // parts > TASK_BYTES:
                    pieces.append(Pieces(held))
                    held, size = [], 0
                held.append((f.path, video, no, parts))
                size += f.size // parts
        return pieces + ([Pieces(held)] if held else [])

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        for path, video, no, parts in partition.value:
            with system.open_input_file(path) as f:
                yield from read_rows(f, path, video, no, parts)


def read_rows(f, path: str, video: str, no: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of part ``no`` of an open array file; an empty or one-dimensional array is a table of no rows or of one."""
    head = io.BytesIO(f.read(min(f.size(), 4096)))
    version = np.lib.format.read_magic(head)
    shape, columns_first, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    if columns_first and len(shape) == 2 and min(shape) > 1 or kind.kind not in "fiu" or len(shape) > 2:
        raise ValueError(f"{path}: not a matrix of numbers in row order")
    n, dim = (0, 1) if 0 in shape else (1, shape[0]) if len(shape) == 1 else shape
    stem = path.rsplit("/", 1)[-1].removesuffix(".npy")
    base = 0 if stem == video else int(stem)
    first, last = n * no // parts, n * (no + 1) // parts
    for a in range(first, last, BATCH_ROWS):
        b = min(last, a + BATCH_ROWS)
        f.seek(head.tell() + a * dim * kind.itemsize)
        flat = np.frombuffer(f.read((b - a) * dim * kind.itemsize), dtype=kind).astype(np.float32)
        ends = pa.array(np.arange(0, (b - a + 1) * dim, dim, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array([video] * (b - a)), pa.array(np.arange(base + a, base + b)), pa.ListArray.from_arrays(ends, pa.array(flat))],
            ["video_id", "pos", "embedding"])


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """video_id, pos, embedding of the array files under ``path``."""
    spark.dataSource.register(ArrayVectors)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("array_vectors").option("path", path).load()


def write_vectors(vectors: DataFrame, path: str, rows: int = 50_000) -> None:
    """Vectors (video_id, pos, embedding; positions without gaps) as <path>/<video_id>/<first pos>.npy of at most ``rows`` rows.

    A video of any length is many tasks. A repeated task writes the same files again.
    """

    def write(pdf):
        pdf = pdf.sort_values("pos")
        system, root = file_system(path)
        folder = f"{root}/{pdf.video_id.iloc[0]}"
        system.create_dir(folder, recursive=True)
        out = io.BytesIO()
        np.save(out, np.array(pdf.embedding.tolist(), dtype=np.float32))
        with system.open_output_stream(f"{folder}/{int(pdf.pos.iloc[0])}.npy") as f:
            f.write(out.getvalue())
        return pdf[["video_id"]].iloc[:1]

    chunks = vectors.select("video_id", "pos", "embedding").groupBy("video_id", F.floor(F.col("pos") / rows).alias("_c"))
    chunks.applyInPandas(write, "video_id string").count()


def write_named_files(files: DataFrame, path: str) -> None:
    """Rows (name, value) as text files <path>/<name>; the folders in a name are made. A repeated task writes the same files again."""

    def write(batches):
        system, root = file_system(path)
        for pdf in batches:
            for name, value in zip(pdf.name, pdf.value):
                system.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{root}/{name}") as f:
                    f.write(value.encode())
            yield pdf[["name"]].iloc[:0]

    files.select("name", "value").mapInPandas(write, "name string").count()
