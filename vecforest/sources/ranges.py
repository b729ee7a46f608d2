"""Files read by byte ranges: NPY matrices and single large JSON documents, each range a partition.

Files are opened with pyarrow's file systems, so a path is a local or shared one or has a
scheme that pyarrow knows.
"""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vecforest.sources.tables import materialize

RANGE, ROWS, LEAD = 16 << 20, 10_000, 4096
QUOTE, BACKSLASH, COMMA = ord('"'), ord("\\"), ord(",")


def opened(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def files_below(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder with this ending."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    head = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = system.get_file_info(name)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((head + f.path, f.size) for f in found if f.is_file and (f.path.endswith(suffix) or info.is_file))


class Part(InputPartition):
    def __init__(self, path: str, size: int, number: int, parts: int):
        self.path, self.size, self.number, self.parts = path, size, number, parts

    @property
    def range(self) -> tuple[int, int]:
        return self.size * self.number // self.parts, self.size * (self.number + 1) // self.parts


class RangeReader(DataSourceReader):
    """One partition for each range of about `bytes` bytes of each file."""

    suffix = ""

    def __init__(self, options):
        self.path, self.bytes, self.options = options["path"], int(options.get("bytes", RANGE)), dict(options)

    def partitions(self) -> list[Part]:
        out = []
        for path, size in files_below(self.path, self.suffix):
            parts = max(1, -(-size // self.bytes))
            out += [Part(path, size, k, parts) for k in range(parts)]
        return out


def npy_header(f) -> tuple[tuple[int, int], np.dtype, bool, int]:
    """Shape, type, whether columns lie together, and where the numbers begin."""
    start = f.read(12)
    if start[:6] != b"\x93NUMPY" or start[6] not in (1, 2, 3):
        raise ValueError("no NPY file of version 1 to 3")
    size, at = (struct.unpack_from("<H", start, 8)[0], 10) if start[6] == 1 else (struct.unpack_from("<I", start, 8)[0], 12)
    f.seek(at)
    head = ast.literal_eval(f.read(size).decode("latin1"))
    if head["descr"] not in ("<f4", "<f8") or len(head["shape"]) != 2:
        raise ValueError("only two-dimensional <f4 and <f8 are read")
    return head["shape"], np.dtype(head["descr"]), head["fortran_order"], at + size


class NpyReader(RangeReader):
    suffix = ".npy"

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with opened(part.path) as f:
            (n, d), kind, columns, at = npy_header(f)
            if part.size != at + n * d * kind.itemsize:
                raise ValueError("the length does not fit the shape")
            first, last = n * part.number // part.parts, n * (part.number + 1) // part.parts
            for a in range(first, last, ROWS):
                m = min(ROWS, last - a)
                if columns:
                    x = np.empty((m, d))
                    for j in range(d):
                        f.seek(at + (j * n + a) * kind.itemsize)
                        x[:, j] = np.frombuffer(f.read(m * kind.itemsize), kind)
                else:
                    f.seek(at + a * d * kind.itemsize)
                    x = np.frombuffer(f.read(m * d * kind.itemsize), kind).reshape(m, d).astype(float)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * d), pa.array(x.ravel()))
                yield pa.record_batch([pa.array([part.path] * m), pa.array(np.arange(a, a + m)), vectors], ["path", "row", "vector"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_ranges"

    def schema(self) -> str:
        return "path string, row long, vector array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, bytes_: int = RANGE) -> DataFrame:
    """(path, row, vector) of a file or a folder of NPY files, in either order; a large file is read by many tasks."""
    spark.dataSource.register(NpySource)
    return spark.read.format("npy_ranges").option("bytes", bytes_).load(path)


def write_npy(vecs: DataFrame, path: str, rows: int = 100_000) -> None:
    """Vectors of one length as NPY files of up to `rows` rows in a folder, in the rows' order within each task; one task writes its files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import uuid

        def put(x: np.ndarray) -> int:
            raw = io.BytesIO()
            np.save(raw, x)
            system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            system.create_dir(name)
            with system.open_output_stream(f"{name}/part-{uuid.uuid4().hex}.npy") as f:
                f.write(raw.getvalue())
            return len(x)

        held, n, done = [], 0, 0
        for batch in batches:
            if len(batch):
                held.append(batch["vector"].flatten().to_numpy().reshape(len(batch), -1))
                n += len(batch)
            if n >= rows:
                done += put(np.concatenate(held))
                held, n = [], 0
        if n:
            done += put(np.concatenate(held))
        yield pa.record_batch([pa.array([done], pa.int64())], ["rows"])

    vecs.select("vector").mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


# One large JSON document


def structure(raw: np.ndarray, escaped: bool, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Which bytes are inside a string, how much each changes the depth, and whether the end is inside a string.

    escaped: an odd number of backslashes stands before the first byte.
    """
    back = raw == BACKSLASH
    at = np.flatnonzero(back)
    odd = np.zeros(len(raw) + 1, bool)  # whether the byte is escaped
    odd[0] = escaped
    if len(at):
        first = np.flatnonzero(np.append(True, np.diff(at) > 1))  # runs of backslashes
        start, length = at[first], np.diff(np.append(first, len(at)))
        length = length + ((start == 0) & escaped)
        end = at[np.append(first[1:], len(at)) - 1] + 1
        odd[end] = length % 2 == 1
        odd[0] = escaped and raw[0] != BACKSLASH
    quote = (raw == QUOTE) & ~odd[: len(raw)]
    within = (np.cumsum(quote) + int(inside)) % 2 == 1
    within_end = bool(within[-1]) if len(raw) else inside
    step = np.isin(raw, list(b"[{")).astype(np.int64) - np.isin(raw, list(b"]}"))
    step[within] = 0
    return within, step, within_end


def odd_before(f, start: int) -> bool:
    """Whether an odd number of backslashes ends just before a place."""
    n, at = 0, start
    while at:
        step = min(at, LEAD)
        f.seek(at - step)
        block = f.read(step)
        run = len(block) - len(block.rstrip(b"\\"))
        n, at = n + run, at - step
        if run < step:
            break
    return n % 2 == 1


class SummaryReader(RangeReader):
    """For each range: its number of quotes modulo two, and its change of depth if it starts outside or inside a string."""

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        a, b = part.range
        with opened(part.path) as f:
            escaped = odd_before(f, a)
            f.seek(a)
            raw = np.frombuffer(f.read(b - a), np.uint8)
        _, outside, end = structure(raw, escaped, False)
        _, inside, _ = structure(raw, escaped, True)
        yield pa.record_batch([pa.array([part.path]), pa.array([part.number]), pa.array([end]), pa.array([int(outside.sum())]), pa.array([int(inside.sum())])], ["path", "number", "odd", "outside", "inside"])


class SummarySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_summaries"

    def schema(self) -> str:
        return "path string, number long, odd boolean, outside long, inside long"

    def reader(self, schema) -> SummaryReader:
        return SummaryReader(self.options)


class ElementReader(RangeReader):
    """The elements of lists of the top level that begin in a range, and the lists that do. An element that goes on in the next range is read to its end."""

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        inside, depth = json.loads(self.options["states"])[part.path][part.number]
        a, b = part.range
        with opened(part.path) as f:
            f.seek(0)
            level = 1 if f.read(LEAD).decode("utf-8-sig", "ignore").lstrip()[:1] == "[" else 2
            escaped = odd_before(f, a)
            f.seek(a)
            data = f.read(b - a)
            raw = np.frombuffer(data, np.uint8)
            within, step, _ = structure(raw, escaped, inside)
            deep = depth + np.cumsum(step)
            open_list = (step > 0) & (raw == ord("[")) & (deep == level)
            comma = (raw == COMMA) & ~within & (deep == level)
            close = (step < 0) & (deep == level - 1)
            marks = np.flatnonzero(open_list | comma | close)
            # A comma at the level also parts the members of an object of the top level: what it opens is known by its list only.
            out = {"offset": [], "kind": [], "text": []}
            for k, m in enumerate(marks.tolist()):
                if open_list[m]:
                    f.seek(max(0, a + m - LEAD))
                    out["offset"].append(a + m)
                    out["kind"].append("list")
                    out["text"].append(key_before(f.read(min(LEAD, a + m))) if level == 2 else "")
                elif (step[m] > 0) or close[m]:
                    if close[m]:
                        out["offset"].append(a + m)
                        out["kind"].append("end")
                        out["text"].append("")
                    continue
                end = int(marks[k + 1]) if k + 1 < len(marks) else None
                text = data[m + 1 : end] if end is not None else data[m + 1 :] + self.rest(f, b, bool(within[-1]), int(deep[-1]), level, part.size)
                if text.strip():
                    out["offset"].append(a + m + 1)
                    out["kind"].append("element")
                    out["text"].append(text.decode("utf-8").strip())
        yield pa.record_batch([pa.array([part.path] * len(out["offset"]), pa.string()), pa.array(out["offset"], pa.int64()), pa.array(out["kind"], pa.string()), pa.array(out["text"], pa.string())], ["path", "offset", "kind", "text"])

    def rest(self, f, at: int, inside: bool, depth: int, level: int, size: int) -> bytes:
        """What follows of an element after a range, up to the comma or bracket that ends it."""
        out, escaped = b"", odd_before(f, at)
        while at < size:
            f.seek(at)
            data = f.read(1 << 16)
            raw = np.frombuffer(data, np.uint8)
            within, step, inside = structure(raw, escaped, inside)
            deep = depth + np.cumsum(step)
            ends = np.flatnonzero(((raw == COMMA) & ~within & (deep == level)) | ((step < 0) & (deep == level - 1)))
            if len(ends):
                return out + data[: ends[0]]
            out, at, depth = out + data, at + len(data), int(deep[-1])
            escaped = odd_before(f, at)
        return out


def key_before(data: bytes) -> str:
    """The member's name that ends, with its colon, at the end of data."""
    text = data.rstrip()
    if not text.endswith(b":"):
        raise ValueError("a list of the top level has no name")
    text = text[:-1].rstrip()
    start = len(text) - 1
    while True:
        start = text.rfind(b'"', 0, start)
        if start < 0:
            raise ValueError(f"a name is over {LEAD} bytes long")
        if (start - len(text[:start].rstrip(b"\\"))) % 2 == 0:
            return json.loads(text[start:].decode("utf-8"))


class ElementSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_elements"

    def schema(self) -> str:
        return "path string, offset long, kind string, text string"

    def reader(self, schema) -> ElementReader:
        return ElementReader(self.options)


def read_json_elements(spark: SparkSession, path: str, bytes_: int = RANGE) -> DataFrame:
    """(path, list, offset, text): the elements of every list of the top level of JSON documents, as texts, with the list's name, read by many tasks.

    A first pass finds for each range the quotes and brackets in it, under both
    assumptions on whether it starts inside a string; from these, one row for each range,
    the driver knows the state at the start of each. Elements are in the order of their
    offset. A document that is itself a list has one list without a name.
    """
    spark.dataSource.register(SummarySource)
    spark.dataSource.register(ElementSource)
    read = lambda kind: spark.read.format(kind).option("bytes", bytes_)
    states: dict[str, list] = {}
    now: dict[str, tuple[bool, int]] = {}
    for r in sorted(read("json_summaries").load(path).collect(), key=lambda r: (r.path, r.number)):  # one row for each range
        inside, depth = now.get(r.path, (False, 0))
        states.setdefault(r.path, []).append([inside, depth])
        now[r.path] = (inside ^ r.odd, depth + (r.inside if inside else r.outside))
    if broken := [p for p, s in now.items() if s != (False, 0)]:
        raise ValueError(f"no whole JSON document: {broken[0]}")
    rows = materialize(read("json_elements").option("states", json.dumps(states)).load(path))
    edges = rows.filter("kind <> 'element'").select("path", "offset", "kind", "text")
    nexts = edges.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "kind", "text"))).alias("edges"))  # the lists and ends of members of the top level
    found = rows.filter("kind = 'element'").join(nexts, "path")
    last = F.try_element_at(F.filter("edges", lambda e: e["offset"] < F.col("offset")), F.lit(-1))
    return found.withColumn("of", last).filter("of.kind = 'list'").select("path", F.col("of.text").alias("list"), "offset", "text")


def read_graph_json(spark: SparkSession, path: str, schemas: dict[str, str], bytes_: int = RANGE) -> dict[str, DataFrame]:
    """The tables of a saved graph in JSON (roots, nodes, edges, texts, vectors): for each list its elements, parsed by the given schema, with their offset as order."""
    elements = materialize(read_json_elements(spark, path, bytes_))
    return {name: elements.filter(F.col("list") == name).select("offset", F.from_json("text", schema).alias("r")).select("offset", "r.*") for name, schema in schemas.items()}
