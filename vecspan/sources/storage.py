"""Files of the archive and shard formats: opening by URI, and writing in two phases.

Tasks write under a staging folder of their job. When all are done the driver moves the data files into
place and then the files by which readers find them, so a reader sees a job's output as a whole or not at all. A
job that fails deletes its staging folder, with whatever lost or repeated tasks have left there.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def storage(uri: str):
    """(file system, path) of a URI or plain path, by pyarrow."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    return fs.LocalFileSystem(), uri


def scratch_uri(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or where that is unset, in local mode, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.gettempdir()}/vecspan-scratch"
    uri = f"{shared.rstrip('/')}/vecspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return uri


class Staging:
    """The output of one job in a folder."""

    def __init__(self, uri: str) -> None:
        self.uri, self.job = uri.rstrip("/"), uuid.uuid4().hex

    @property
    def folder(self) -> str:
        return f"{self.uri}/_staging-{self.job}"

    def create(self, name: str):
        """A file of the staging folder, open for writing; sub-folders are not made."""
        fs, path = storage(self.folder)
        fs.create_dir(path, recursive=True)
        return fs.open_output_stream(f"{path}/{name}")

    def target(self, name: str) -> str:
        """Where a file will be, as readers of other tools see it: without the scheme of local files."""
        fs, path = storage(self.uri)
        return f"{path}/{name}" if fs.type_name == "local" else f"{self.uri}/{name}"

    def publish(self, names: list[str]) -> None:
        """Move these files into place, in this order."""
        fs, path = storage(self.uri)
        fs.create_dir(path, recursive=True)
        for name in names:
            fs.move(f"{path}/_staging-{self.job}/{name}", f"{path}/{name}")

    def old_files(self, suffixes: tuple[str, ...]) -> list[str]:
        """Names of the folder's published files with one of the suffixes."""
        return [name for name, _ in published(self.uri, suffixes)]

    def remove(self, names: list[str]) -> None:
        fs, path = storage(self.uri)
        for name in names:
            fs.delete_file(f"{path}/{name}")

    def clear(self) -> None:
        """Delete the staging folder."""
        from pyarrow.fs import FileType

        fs, path = storage(self.folder)
        if fs.get_file_info(path).type != FileType.NotFound:
            fs.delete_dir(path)


def published(uri: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(name, size) of the files of a folder with one of the suffixes, in order; of a file itself its name."""
    from pyarrow.fs import FileSelector, FileType

    fs, path = storage(uri.rstrip("/"))
    info = fs.get_file_info(path)
    if info.type == FileType.File:
        return [("", info.size)]
    found = fs.get_file_info(FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.type == FileType.File and f.base_name.endswith(suffixes) and f.base_name[0] not in "_.")


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared scratch folder and read back."""
    uri = scratch_uri(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)
