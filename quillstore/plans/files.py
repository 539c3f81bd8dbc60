"""Small-file access through Hadoop's file systems, so that any store that Spark reads works on the driver too."""

from __future__ import annotations

from pyspark.sql import SparkSession


class JvmStream:
    """A Java input stream that reads like a Python one."""

    def __init__(self, jvm, stream):
        self.jvm, self.stream = jvm, stream

    def read(self, size: int = -1) -> bytes:
        if size is None or size < 0:
            return bytes(self.stream.readAllBytes())
        return bytes(self.stream.readNBytes(size))

    def close(self) -> None:
        self.stream.close()

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class Files:
    """Files under a root; names may also be full paths or URIs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name if "://" in name or name.startswith(("/", "file:")) else f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        p = self._path(name)
        return self._fs(p).exists(p)

    def is_file(self, name: str) -> bool:
        p = self._path(name)
        fs = self._fs(p)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def size(self, name: str) -> int:
        p = self._path(name)
        return self._fs(p).getFileStatus(p).getLen()

    def list(self, name: str = "") -> list[str]:
        p = self._path(name) if name else self.jvm.org.apache.hadoop.fs.Path(self.root)
        fs = self._fs(p)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def glob(self, pattern: str) -> list[str]:
        p = self._path(pattern)
        return sorted(s.getPath().toString() for s in (self._fs(p).globStatus(p) or []))

    def modified(self, name: str) -> int:
        p = self._path(name)
        return self._fs(p).getFileStatus(p).getModificationTime()

    def read(self, name: str) -> str:
        p = self._path(name)
        stream = self._fs(p).open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write aside, then rename over the old file: readers see the old text or the new one, never neither."""
        p, tmp = self._path(name), self._path(f"{name}.tmp")
        fs = self._fs(p)
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        self.replace(tmp, p)

    def replace(self, source, target) -> None:
        """Rename a file over another in one step."""
        modes = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        modes[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        fs = self._fs(target)
        source, target = fs.makeQualified(source), fs.makeQualified(target)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(source, target, modes)

    def open(self, name: str) -> JvmStream:
        """A file's bytes as a stream."""
        p = self._path(name)
        return JvmStream(self.jvm, self._fs(p).open(p))

    def mirror(self, folder: str, target: str) -> list[str]:
        """Make a folder hold the files of another, no more and no fewer; a file of the same size is taken as the same.
        Returns the names that were copied."""
        here, copied = self.list(folder), []
        for name in set(self.list(target)) - set(here):
            self.delete(f"{target}/{name}")
        for name in here:
            a, b = f"{folder}/{name}", f"{target}/{name}"
            if not self.exists(b) or not self.is_file(b) or self.size(a) != self.size(b):
                self.copy(a, b)
                copied.append(name)
        return copied

    def rename(self, a: str, b: str) -> bool:
        p = self._path(a)
        return self._fs(p).rename(p, self._path(b))

    def delete(self, name: str) -> bool:
        p = self._path(name)
        return self._fs(p).delete(p, True)

    def copy(self, a: str, b: str) -> bool:
        src, dst = self._path(a), self._path(b)
        return self.jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs(src), src, self._fs(dst), dst, False, True, self.conf)
