"""Small numbered JSON files that say which folders make up a table: what a table is changes in one step, by one new file."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class CommitLog:
    """``{path}/{number}.json``.  A number is taken by one writer only; a file that was cut off by a crash does not count."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.path = path

    def _at(self, name: str = ""):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path, path.getFileSystem(self._conf)

    def numbers(self) -> list[int]:
        """All numbers taken, newest first."""
        path, files = self._at("*.json")
        found = [status.getPath().getName().removesuffix(".json") for status in files.globStatus(path) or []]
        return sorted((int(name) for name in found if name.isdigit()), reverse=True)

    def read(self, number: int) -> dict | None:
        path, files = self._at(f"{number:010d}.json")
        lines = self._jvm.org.apache.commons.io.IOUtils.toString(files.open(path), "UTF-8")
        # The last thing written is the line's end.
        return json.loads(lines) if lines.endswith("\n") else None

    def newest(self) -> tuple[int, dict] | None:
        for number in self.numbers():
            content = self.read(number)
            if content is not None:
                return number, content
        return None

    def put(self, content: dict, after: int | None) -> int:
        """Commit on top of commit ``after``; an error if somebody else has done so in the meantime."""
        taken = self.numbers()
        number = (taken[0] if taken else -1) + 1
        found = self.newest()
        if (found[0] if found else None) != after:
            raise RuntimeError(f"{self.path} has changed since it was read; run the write again")
        path, files = self._at(f"{number:010d}.json")
        # Fails if the file is there.
        out = files.create(path, False)
        try:
            out.write(bytearray((json.dumps(content) + "\n").encode()))
        finally:
            out.close()
        return number

    def delete(self, path: str) -> None:
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self._conf).delete(where, True)

    def folders(self, path: str) -> list[str]:
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(self._conf)
        return [status.getPath().getName() for status in files.listStatus(where)] if files.exists(where) else []
