"""JSON lines as a data source of its own, that reads no more than a query asks for.

`spark.dataSource.register(JsonLines)`, then `spark.read.format("jsonlines").schema(...).load(path)`. The option `limit`
stops after so many records of the source. Conditions of equality, membership and null that Spark hands over (with
`spark.sql.python.filterPushdown.enabled`) are checked on the parsed record, before rows are made."""

from __future__ import annotations

import json

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull

#: Bytes of a file that one task reads.
SPLIT = 64 << 20


class JsonLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonlines"

    def schema(self) -> str:
        raise ValueError("jsonlines needs a schema")

    def reader(self, schema) -> JsonLinesReader:
        return JsonLinesReader(schema, self.options)


class Part(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


def _opened(path: str):
    """The file system of a path and the path in it; local ones need no scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class JsonLinesReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names, self.path = list(schema.names), options.get("path")
        self.limit = None if options.get("limit") is None else int(options["limit"])
        self.checks: list[tuple[str, str, object]] = []
        if not self.path:
            raise ValueError("jsonlines needs a path")

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            kind = next((k for k in (EqualTo, In, IsNotNull, IsNull) if isinstance(f, k)), None)
            if kind is None or len(f.attribute) != 1:
                yield f
            else:
                self.checks.append((kind.__name__, f.attribute[0], getattr(f, "value", None)))

    def partitions(self):
        from pyarrow import fs

        system, at = _opened(self.path)
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else sorted((i for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.is_file and not i.base_name.startswith(("_", "."))), key=lambda i: i.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        if self.limit is not None:  # the first records of the source are in one reader's hands
            return [Part("\n".join(f"{scheme}{i.path}" for i in files), 0, None)]
        return [Part(f"{scheme}{i.path}", s, min(s + SPLIT, i.size)) for i in files for s in range(0, max(1, i.size), SPLIT)]

    def _lines(self, part: Part):
        """Lines that begin in a part, with where they do; blank ones are skipped."""
        for path in part.path.split("\n"):
            if not path:
                continue
            system, at = _opened(path)
            with system.open_input_file(at) as raw:
                import io

                f = io.BufferedReader(raw, 1 << 16)
                where = part.start
                if where:
                    f.seek(where - 1)
                    where += len(f.readline()) - 1
                while part.stop is None or where < part.stop:
                    line = f.readline()
                    if not line:
                        break
                    if line.strip():
                        yield path, where, line
                    where += len(line)

    def _passes(self, record: dict) -> bool:
        for kind, name, value in self.checks:
            own = record.get(name)
            if kind == "IsNull":
                if own is not None:
                    return False
            elif own is None or kind == "EqualTo" and own != value or kind == "In" and own not in value:
                return False
        return True

    def read(self, partition: Part):
        left = self.limit
        for path, where, line in self._lines(partition):
            if left is not None:
                if not left:
                    return
                left -= 1
            try:
                record = json.loads(line)
            except ValueError:
                record = None
            if not isinstance(record, dict):
                raise ValueError(f"{path} byte {where} is no JSON object: {line[:80]!r}")
            if self._passes(record):
                yield tuple(record.get(n) for n in self.names)
