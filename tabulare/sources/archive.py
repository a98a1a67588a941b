"""ZIP archives of fixed-width text.

Spark has no ZIP codec and would read an archive as one value. Here a Python
data source plans its partitions from the archives' central directories (the
last bytes of each file), and each task reads the byte range of its members,
inflates each as a stream and hands on its lines in bounded chunks. No archive
is ever held whole, an archive's members are read in parallel, and bytes of
other members are not touched. A member is one stream, so never more than one
task; small members share one, as small files do in Spark's file scan (without
that, tasks would grow in number with the members). Several archives of one
state are just more members.

Broken input: an archive without a readable directory, a member whose
checksum fails, an encrypted member or one packed by a method Python does not
have. By default it fails the job. With ``broken="reject"`` it becomes one row
with the reason in ``erro`` (``membro`` NULL if the directory is unreadable)
and none of its lines; to give none, a member's checksum is then verified
before its lines are read. The other members of the archive are read.

Files are listed by Spark's file system and opened by tasks through
``pyarrow.fs`` (local, HDFS, S3, GCS, ABFS).
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tabulare.session import local_fs_path

LINES_SCHEMA = "arquivo string, membro string, linha long, value string, erro string"
MEMBERS_SCHEMA = "arquivo string, membro string, bytes long, erro string"
CHUNK_LINES = 20_000
TASK_BYTES = 64 << 20      # unpacked; members up to this much share a task
MEMBER_COST = 16 << 10     # bytes that could be read while a member is opened
TASKS_PER_CORE = 4         # as many at least, if there are as many members
_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)
_LOCAL_HEADER = b"PK\x03\x04"
_ENCRYPTED = 1             # bit of a member's flags


class _Ranges(io.RawIOBase):
    """A file of ``pyarrow`` as Python's own kind, with its errors."""

    def __init__(self, file):
        self.file, self.size = file, file.size()

    def readable(self) -> bool:
        return True

    seekable = readable

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.size)[whence]
        if at < 0:
            raise OSError("before the start of the file")
        self.file.seek(min(at, self.size))
        return at

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        self.file.close()
        super().close()


def open_file(path: str):
    """A seekable file of any file system ``pyarrow`` knows; bytes are read where asked for."""
    from pyarrow import fs

    local = local_fs_path(path)
    if local is not None:
        return io.BufferedReader(_Ranges(fs.LocalFileSystem().open_input_file(local)))
    system, name = fs.FileSystem.from_uri(path)
    return io.BufferedReader(_Ranges(system.open_input_file(name)))


@dataclass
class Member(InputPartition):
    """One member, as the archive's directory describes it; or why there is none."""

    path: str
    size: int                  # bytes of the archive
    name: str | None = None
    offset: int = 0            # of the local header
    packed: int = 0
    unpacked: int = 0
    method: int = 0
    crc: int = 0
    error: str | None = None

    def open(self):
        """The member's bytes as a stream whose end verifies the checksum."""
        if self.error:
            raise zipfile.BadZipFile(self.error)
        f = open_file(self.path)
        f.seek(self.offset)
        head = f.read(30)
        if len(head) < 30 or head[:4] != _LOCAL_HEADER:
            raise zipfile.BadZipFile("no local header")
        f.seek(self.offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        info = zipfile.ZipInfo(self.name)
        info.compress_type, info.compress_size, info.file_size, info.CRC = self.method, self.packed, self.unpacked, self.crc
        return zipfile.ZipExtFile(f, "r", info, close_fileobj=True)

    def reason(self) -> str | None:
        """Why the member cannot be read, or ``None``: read to its end in bounded memory."""
        try:
            with self.open() as f:
                while f.read(1 << 20):
                    pass
            return None
        except _BROKEN as ex:
            return self.broken(ex)

    def broken(self, ex: Exception) -> str:
        if self.error:
            return self.error
        return f"bad checksum: {self.name}" if "CRC" in str(ex) else f"{type(ex).__name__}: {ex}"


def directory(path: str, size: int = 0) -> list[Member]:
    """Every member of an archive from its central directory; one without a name if that is unreadable."""
    try:
        with open_file(path) as f, zipfile.ZipFile(f) as zf:
            return [Member(path, size, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC,
                           f"encrypted: {i.filename}" if i.flag_bits & _ENCRYPTED else None)
                    for i in zf.infolist() if not i.is_dir()]
    except _BROKEN as ex:
        return [Member(path, size, error=f"{type(ex).__name__}: {ex}")]


def directories(files: Sequence[tuple[str, int]]) -> list[Member]:
    """The members of all archives, by archive and name; a few kilobytes of each file are read."""
    with ThreadPoolExecutor(16) as pool:
        found = pool.map(lambda f: sorted(directory(*f), key=lambda m: m.name or ""), files)
        return [m for members in found for m in members]


@dataclass
class Members(InputPartition):
    """The members that one task reads, one after the other."""

    members: list[Member]


def packed(members: Sequence[Member], tasks: int) -> list[Members]:
    """Neighbours together up to ``TASK_BYTES``, or less where that would leave fewer than ``tasks`` partitions."""
    cost = [m.unpacked + MEMBER_COST for m in members]
    most = min(TASK_BYTES, sum(cost) / max(tasks, 1))
    out: list[Members] = []
    room = 0.0
    for m, c in zip(members, cost):
        if not out or c > room:
            out.append(Members([]))
            room = most
        out[-1].members.append(m)
        room -= c
    return out


def is_text(m: Member) -> bool:
    return m.name is None or m.name.lower().endswith(".txt")


class ZipMembers(DataSource):
    """``spark.read.format("zip_members")``: text lines of archives, or what checking every member gives.

    Options: ``files`` (JSON list of path and size), ``check`` (members instead
    of lines), ``broken`` (``fail`` or ``reject``), ``tasks`` (partitions at
    least, if there are as many members).
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return MEMBERS_SCHEMA if self.options.get("check") == "true" else LINES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files = [tuple(f) for f in json.loads(options["files"])]
        self.check = options.get("check") == "true"
        self.reject = options.get("broken") == "reject"
        self.tasks = int(options.get("tasks") or 1)

    def partitions(self) -> Sequence[InputPartition]:
        found = directories(self.files)
        return packed(found if self.check else [m for m in found if is_text(m)], self.tasks)

    def read(self, partition: Members | None) -> Iterator[pa.RecordBatch]:
        for m in partition.members if partition else ():      # no partition at all: Spark asks once
            yield from self.read_member(m)

    def read_member(self, m: Member) -> Iterator[pa.RecordBatch]:
        if self.check:
            yield _rows(arquivo=[m.path], membro=[m.name], bytes=pa.array([m.size], pa.int64()), erro=[m.reason()])
            return
        reason = (m.error or self.reject and m.reason()) or None
        if reason and not self.reject:
            raise ValueError(f"broken archive {m.path}: {reason}")
        if reason:
            yield _rows(arquivo=[m.path], membro=[m.name], linha=pa.array([None], pa.int64()), value=[None], erro=[reason])
            return
        try:
            yield from _member_lines(m)
        except _BROKEN as ex:
            raise ValueError(f"broken archive {m.path}: {m.broken(ex)}") from ex


def _rows(**columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.string()) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _member_lines(m: Member) -> Iterator[pa.RecordBatch]:
    start, part = 0, []

    def frame():
        n = len(part)
        return _rows(arquivo=[m.path] * n, membro=[m.name] * n, linha=pa.array(range(start, start + n), pa.int64()), value=part,
                     erro=[None] * n)
    # Latin-1 never fails (S3); a text file breaks lines at CR and LF only
    with m.open() as raw, io.TextIOWrapper(raw, "latin-1") as text:
        for line in text:
            part.append(line.rstrip("\n"))
            if len(part) == CHUNK_LINES:
                yield frame()
                start, part = start + len(part), []
    if part:
        yield frame()


def archive_files(spark: SparkSession, paths, names: str | None = None) -> list[tuple[str, int]]:
    """Path and size of every file that the paths, folders or globs name (``names``: a glob on file names).

    Empty files are left out, as Spark's file scan does.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    accepts = jvm.org.apache.hadoop.fs.GlobFilter(names).accept if names else lambda p: True
    found = []
    for path in [paths] if isinstance(paths, str) else list(paths):
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        matched = fs.globStatus(p)
        if not matched:
            raise FileNotFoundError(f"no file at {path}")
        for st in matched:
            for f in fs.listStatus(st.getPath()) if st.isDirectory() else [st]:
                name = f.getPath().getName()
                if f.isFile() and f.getLen() and name[0] not in "_." and accepts(f.getPath()):
                    found.append((f.getPath().toString(), f.getLen()))
    return sorted(set(found))


def _read(spark: SparkSession, paths, names: str | None = None, **options) -> DataFrame:
    from tabulare.session import ship_package

    ship_package(spark)                  # tasks run this module
    spark.dataSource.register(ZipMembers)
    reader = spark.read.format("zip_members").option("files", json.dumps(archive_files(spark, paths, names)))
    reader = reader.option("tasks", spark.sparkContext.defaultParallelism * TASKS_PER_CORE)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def archive_lines(spark: SparkSession, paths, broken: str = "fail", names: str | None = None) -> DataFrame:
    """Every line of every ``.txt`` member of every archive (``names``: a glob on file names).

    Lines come back Latin-1-decoded: parse them with ``parse_fwf(..., encoding=None)``.
    ``broken`` is ``"fail"`` or ``"reject"`` (see module note).
    """
    if broken not in ("fail", "reject"):
        raise ValueError("broken must be 'fail' or 'reject'")
    return _read(spark, paths, names, broken=broken)


def archives_without_text(spark: SparkSession, paths) -> list[str]:
    """Archives whose directory names no text member; nothing but directories is read."""
    files = archive_files(spark, paths)
    with_text = {m.path for m in directories(files) if is_text(m)}
    return [path for path, _ in files if path not in with_text]


def archive_validity(spark: SparkSession, paths) -> DataFrame:
    """Per archive, whether it opens and every member passes its CRC check.

    Zero-byte files are left out (absent and invalid lead to the same
    re-fetch); an archive without members is valid.
    """
    checked = _read(spark, paths, check="true").groupBy("arquivo").agg(
        F.bool_and(F.col("erro").isNull()).alias("valido"), F.count("membro").cast("int").alias("n_membros"), F.max("bytes").alias("bytes"))
    files = spark.createDataFrame(archive_files(spark, paths), "file string, size long")
    return files.join(checked, files["file"] == checked["arquivo"], "left").select(
        F.col("file").alias("arquivo"), F.coalesce("valido", F.lit(True)).alias("valido"),
        F.coalesce("n_membros", F.lit(0)).alias("n_membros"), F.col("size").alias("bytes"))
