"""A registry of sources, and landed payloads as a Spark data source (the extension point for new connectors)."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

REGISTRY: dict[str, type] = {}


def register(cls: type) -> type:
    """Class decorator; a name can be taken once."""
    name = cls.name()
    if name in REGISTRY:
        raise ValueError(f"source {name!r} is registered already")
    REGISTRY[name] = cls
    return cls


@register
class LandedPayloads(DataSource):
    """spark.read.format("landed").option("boards", "token=path,token=path").option("source", name).load(): one row per board.

    The paths are local ones, which every executor must see: a folder that all share. A board whose file is missing gives a null payload, which
    counts as blocked, only with the option missing=blocked; else the read fails. Bytes that are no UTF-8 are replaced. In stores
    that only Spark reads, landed() of payloads.py does the same."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return "source string, token string, company string, payload string"

    def reader(self, schema):
        return _Reader(self.options)


class _Board(InputPartition):
    def __init__(self, token: str, path: str):
        self.token, self.path = token, path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.source, self.boards = options.get("source", ""), options.get("boards", "")
        self.lenient = options.get("missing", "") == "blocked"

    def partitions(self):
        return [_Board(*b.split("=", 1)) for b in self.boards.split(",") if "=" in b] or [_Board("", "")]

    def read(self, partition):
        if not partition.path:
            return
        try:
            with open(partition.path, encoding="utf-8", errors="replace") as f:
                payload = f.read()
        except FileNotFoundError:
            if not self.lenient:
                raise
            payload = None
        yield self.source, partition.token, partition.token, payload
