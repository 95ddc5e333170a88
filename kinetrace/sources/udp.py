"""Datagrams as a stream: one row for each. The port is the only thing a receiver needs."""

from __future__ import annotations

import socket
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class UdpReader(SimpleDataSourceStreamReader):
    """Drains what has come since the last read, up to ``limit`` rows, as one batch. Datagrams cannot be asked
    for again: what was read stays here until it is committed."""

    def __init__(self, options: dict[str, str]):
        self.limit, self.kept, self.socket = int(options.get("limit", 10_000)), {}, None
        self.address = options.get("host", "127.0.0.1"), int(options.get("port", 3333))
        self.wait = float(options.get("wait", 0.05))

    def _open(self) -> socket.socket:
        """Binds with the first read: readers are also made, and sent about, without being read from."""
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.setsockopt(socket.SOL_SOCKET, socket.SO_REUSEADDR, 1)
            self.socket.bind(self.address)
            self.socket.settimeout(self.wait)
        return self.socket

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = []
        self._open()
        while len(rows) < self.limit:
            try:
                data, _ = self.socket.recvfrom(2048)
            except TimeoutError:
                break
            rows.append((data.decode("utf-8", "replace").strip(),))
        end = start["rows"] + len(rows)
        self.kept[start["rows"], end] = rows
        return iter(rows), {"rows": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.kept.get((start["rows"], end["rows"]), []))

    def commit(self, end: dict) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k[1] > end["rows"]}


class UdpSource(DataSource):
    """``spark.dataSource.register(UdpSource)``, then ``readStream.format("udp").option("port", …)``."""

    @classmethod
    def name(cls) -> str:
        return "udp"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema: StructType) -> UdpReader:
        return UdpReader(self.options)
