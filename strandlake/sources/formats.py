"""Sequence files as Spark formats: ``spark.read.format("fastq")``, ``readStream``, ``write`` and ``writeStream``.

``register(spark)`` adds the formats ``fasta``, ``fastq`` and ``sam``. Tables are read in planned splits of ``splitBytes``: a split begins
at the format's first boundary behind its start and ends at the next split's, so no record is lost or met twice. Modes
are those of the other readers (option ``mode``). Tests of equality, membership and prefix on a record's first column are
done where records are parsed; malformed records are met before them.

Streams read the files that appear in a folder. Which files make a batch is written down in the folder of the option
``log`` before Spark plans the batch, and an offset is a number of such lists: a query that is stopped anywhere and started
again from its checkpoint reads the same files in the same batches. A file must appear whole (be moved there).

Writers put each task's records into a file under ``_temporary``; on commit the files are moved beside it, on abort they go. A
stream's files are named by batch, and a batch that is committed already is not written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from strandlake.shipping import ship
from strandlake.sources import fastq
from strandlake.sources.modes import CORRUPT, known

SPLIT_BYTES = 64 << 20

# Records of lines. Each format has: its columns; the place of the first record among lines that begin anywhere (None: there is
# none); its records, as (values, fault), that begin before ``end``; the text of a record.


def _fasta_records(lines, end=None):
    name, parts, begun = None, [], 0

    def closed():
        sequence = "".join(parts)
        if begun == 0:
            return (name or "", sequence), "no sequence follows the header, or the file does not start with '>'"
        if not name.strip():
            return (name, sequence), "the header is empty"
        if ">" in name or ">" in sequence:
            return (name, sequence), "'>' stands inside a line"
        return (name, sequence), None if sequence.strip() else "the sequence is empty"

    for at, line in lines:
        if line.startswith(">"):
            if name is not None:
                yield closed()
            if end is not None and at >= end:
                return
            name, parts, begun = line[1:], [], 1
        elif name is not None:
            parts.append(line)
        elif line.strip():
            name, parts, begun = line, [], 0
    if name is not None:
        yield closed()


def _fasta_boundary(lines):
    return next((at for at, line in lines if line.startswith(">")), None)


def _sam_records(lines, end=None):
    for at, line in lines:
        if end is not None and at >= end:
            return
        if not line or line.startswith("@"):
            continue
        f = line.split("\t")
        number = lambda x: int(x) if x.isascii() and x.isdigit() else None
        f += [None] * (11 - len(f)) if len(f) < 11 else []
        values = [number(x or "") for x in (f[1], f[3], f[4])]
        bare = lambda x: "" if x == "*" else x
        wrong = None
        if f[10] is None:
            wrong = "fewer than 11 fields"
        elif values[0] is None or values[0] > 65535:
            wrong, values[0] = "the flag is no number of 16 bits", None
        elif values[1] is None:
            wrong = "the position is no number from 0 on"
        elif values[2] is None or values[2] > 255:
            wrong, values[2] = "the mapping quality is no number of 8 bits", None
        elif not all("!" <= c <= "~" for c in f[10]):
            wrong = "the quality scores are not graphic ASCII"
        yield (f[0], values[0], f[2], values[1], values[2], bare((f[5] or "").strip()), "*", 0, 0, f[9], bare(f[10]), f[11:]), wrong


def _sam_boundary(lines):
    return next((at for at, _ in lines), None)


def _fastq_records(lines, end=None):
    for header, sequence, quality, wrong in fastq.entries(lines, end):
        yield (header, sequence, quality), wrong


def _sam_text(r):
    star = lambda x: x or "*"
    first = [r["qname"], r["flag"], r["rname"], r["pos"], r["mapq"], star(r["cigar"]), r["rnext"], r["pnext"], r["tlen"], star(r["seq"]), star(r["qual"])]
    return "\t".join(map(str, [*first, *(r["opt_fields"] or ())]))


FORMATS = {
    "fasta": ("name string, sequence string", _fasta_boundary, _fasta_records, lambda r: f">{r['name']}\n{r['sequence']}"),
    "fastq": (fastq.SCHEMA, fastq.boundary, _fastq_records, lambda r: f"@{r['header']}\n{r['sequence']}\n+\n{r['quality']}"),
    "sam": ("qname string, flag int, rname string, pos bigint, mapq smallint, cigar string, rnext string, pnext bigint, tlen int, seq string, qual string, opt_fields array<string>", _sam_boundary, _sam_records, _sam_text),
}


# Files ---------------------------------------------------------------------------------------------------------------------------


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _uri(path: str, name: str) -> str:
    return (path.split("://")[0] if "://" in path else "file") + "://" + name


def _files(path: str) -> list[tuple[str, int]]:
    """(address, bytes) of the file, or of the folder's files in the order of their names; hidden ones are not read."""
    from pyarrow import fs

    system, name = _system(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(name)) if x.is_file and x.base_name[0] not in "._"]
    return sorted((_uri(path, x.path), x.size) for x in found)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int | None


def _splits(files: list[tuple[str, int]], size: int) -> list[Split]:
    return [Split(p, a, a + size if a + size < n else None) for p, n in files for a in (range(0, max(n, 1), size) if not p.endswith(".gz") else (0,))]


class _Records:
    """What batch and stream readers share: splits in, rows out."""

    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.mode = kind, known(options.get("mode", "FAILFAST"))
        self.path, self.size = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.tests: list[tuple[str, object]] = []

    def rows(self, split: Split) -> Iterator[tuple]:
        _, boundary, records, _ = FORMATS[self.kind]
        whole = split.path.endswith(".gz")
        first = 0
        if split.start and (first := boundary(fastq._opened(split.path, split.start))) is None:
            return
        end = split.end and not whole and boundary(fastq._opened(split.path, split.end)) or None
        if split.start and end == first:
            return
        for values, wrong in records(fastq._opened(split.path, first), end):
            if wrong and self.mode != "PERMISSIVE":
                if self.mode == "FAILFAST":
                    raise ValueError(f"malformed {self.kind} record: {wrong}")
                continue
            if all(values[0] in x if how == "in" else (values[0] or "").startswith(x) for how, x in self.tests):
                yield (*values, wrong) if self.mode == "PERMISSIVE" else values


class Reader(_Records, DataSourceReader):
    def __init__(self, kind: str, options: dict, key: str) -> None:
        super().__init__(kind, options)
        self.key = key

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (self.key,):
                self.tests.append(("in", (f.value,)))
            elif isinstance(f, In) and f.attribute == (self.key,):
                self.tests.append(("in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == (self.key,):
                self.tests.append(("prefix", f.value))
            else:
                yield f

    def partitions(self):
        return _splits(_files(self.path), self.size) or [Split("", 0, None)]

    def read(self, partition):
        if partition.path:
            yield from self.rows(partition)


class StreamReader(_Records, DataSourceStreamReader):
    def __init__(self, kind: str, options: dict) -> None:
        super().__init__(kind, options)
        if "log" not in options:
            raise ValueError("a stream needs the option log: a folder for the lists of the batches' files, which outlives the query")
        self.log = options["log"]

    def _lists(self) -> list[list[tuple[str, int]]]:
        from pyarrow import fs

        system, name = _system(self.log)
        system.create_dir(name, recursive=True)
        found = sorted((x.path for x in system.get_file_info(fs.FileSelector(name)) if x.base_name.endswith(".json")), key=lambda p: int(p.rsplit("/", 1)[1][:-5]))
        return [[tuple(x) for x in json.loads(system.open_input_stream(p).read())] for p in found]

    def initialOffset(self):
        return {"lists": 0}

    def latestOffset(self):
        lists = self._lists()
        seen = {p for x in lists for p, _ in x}
        if new := [x for x in _files(self.path) if x[0] not in seen]:
            system, name = _system(self.log)
            with system.open_output_stream(f"{name}/.{len(lists)}.tmp") as out:
                out.write(json.dumps(new).encode())
            system.move(f"{name}/.{len(lists)}.tmp", f"{name}/{len(lists)}.json")
            lists.append(new)
        return {"lists": len(lists)}

    def partitions(self, start, end):
        return _splits([x for files in self._lists()[start["lists"] : end["lists"]] for x in files], self.size)

    def read(self, partition):
        yield from self.rows(partition)


@dataclass
class Written(WriterCommitMessage):
    path: str


class _Parts:
    """What batch and stream writers share: a file for each task, moved to its place by a commit."""

    def __init__(self, kind: str, options: dict) -> None:
        self.kind, self.path, self.job = kind, options["path"], uuid.uuid4().hex

    def write(self, iterator):
        text = FORMATS[self.kind][3]
        system, name = _system(self.path)
        part = f"{name}/_temporary/{self.job}/part-{uuid.uuid4().hex}.{self.kind}"
        system.create_dir(part.rsplit("/", 1)[0], recursive=True)
        n = 0
        with system.open_output_stream(part) as out:
            for row in iterator:
                out.write((text(row) + "\n").encode())
                n += 1
        if not n:
            system.delete_file(part)
        return Written(part if n else "")

    def _place(self, messages, prefix: str) -> None:
        system, name = _system(self.path)
        for i, m in enumerate(x for x in messages if x is not None and x.path):
            system.move(m.path, f"{name}/{prefix}{i:05d}.{self.kind}")

    def _clear(self) -> None:
        from pyarrow import fs

        system, name = _system(self.path)
        if system.get_file_info(f"{name}/_temporary/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{name}/_temporary/{self.job}")


class Writer(_Parts, DataSourceWriter):
    def __init__(self, kind: str, options: dict, overwrite: bool) -> None:
        super().__init__(kind, options)
        self.overwrite = overwrite

    def commit(self, messages):
        from pyarrow import fs

        system, name = _system(self.path)
        system.create_dir(name, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(name)):
                if x.is_file and x.base_name.endswith(f".{self.kind}"):
                    system.delete_file(x.path)
        self._place(messages, f"part-{self.job[:12]}-")
        self._clear()

    def abort(self, messages):
        self._clear()


class StreamWriter(_Parts, DataSourceStreamWriter):
    def commit(self, messages, batchId):
        from pyarrow import fs

        system, name = _system(self.path)
        system.create_dir(f"{name}/_committed", recursive=True)
        mark = f"{name}/_committed/{batchId}"
        if system.get_file_info(mark).type == fs.FileType.NotFound:
            # a commit that was cut off has left some of the batch's files
            for x in system.get_file_info(fs.FileSelector(name)):
                if x.base_name.startswith(f"batch-{batchId:010d}-"):
                    system.delete_file(x.path)
            self._place(messages, f"batch-{batchId:010d}-")
            system.open_output_stream(mark).close()
        else:
            self._drop(messages)

    def abort(self, messages, batchId):
        self._drop(messages)

    def _drop(self, messages) -> None:
        system, _ = _system(self.path)
        for m in messages:
            if m is not None and m.path:
                system.delete_file(m.path)


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return FORMATS[self.kind][0] + f", {CORRUPT} string" * (self.options.get("mode") == "PERMISSIVE")

    def reader(self, schema):
        return Reader(self.kind, dict(self.options), FORMATS[self.kind][0].split()[0])

    def streamReader(self, schema):
        return StreamReader(self.kind, dict(self.options))

    def writer(self, schema, overwrite):
        return Writer(self.kind, dict(self.options), overwrite)

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.kind, dict(self.options))


class Fasta(_Source):
    kind = "fasta"


class Fastq(_Source):
    kind = "fastq"


class Sam(_Source):
    kind = "sam"


def register(spark: SparkSession) -> None:
    """Add the formats to a session, and let it push tests into formats of its kind, without which it refuses them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Fasta, Fastq, Sam):
        spark.dataSource.register(source)
