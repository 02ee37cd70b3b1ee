"""Small files in whatever file system a path names, by Hadoop's API, so that catalogs and pointers may lie in any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.gateway, self.jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def delete(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.delete(where, True)

    def read(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Replaces the file in one step: readers see the old text or the new one."""
        fs, where = self._at(path)
        part = self.jvm.org.apache.hadoop.fs.Path(path + ".new")
        stream = fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        over = self.gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.makeQualified(where).toUri(), self.conf).rename(fs.makeQualified(part), fs.makeQualified(where), over)
