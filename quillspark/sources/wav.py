"""WAV files as a sink: df.write.format("wav").mode("append").option("folder", shared).save()"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.speech import wav_bytes, write_file


@dataclass
class Written(WriterCommitMessage):
    """How many files a task wrote."""

    files: int


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Written:
        n = 0
        for r in rows:
            if r["path"]:
                write_file(os.path.join(self.folder, r["path"]), wav_bytes(np.frombuffer(r["pcm"] or b"", "<i2"), r["sample_rate"]))
                n += 1
        return Written(n)


class WavDataSource(DataSource):
    """Rows of path (below the folder), pcm (16-bit samples) and sample_rate; rows without a path are left out.

    A file is renamed into place when it is whole, so a task that runs twice leaves the same files as one that
    runs once. The folder must be shared by the executors.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["folder"])
