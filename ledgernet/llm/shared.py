"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterable
from typing import Any
from urllib.parse import urlparse

import numpy as np
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ledgernet.sources.workspace import shared_dir, stored


def handed_out(spark: SparkSession, model: Any) -> Broadcast:
    """Broadcast a model of this package; its class travels along, since workers may lack the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(model))


def received(given: Broadcast) -> Any:
    """The model that was ``handed_out``; a worker reads it once."""
    if not hasattr(given, "model"):
        given.model = pickle.loads(given.value)
    return given.model


def model_folder(spark: SparkSession, name: str) -> str:
    """A new folder that every worker opens as plain files, for models that are mapped into memory.

    The shared folder has to be mounted on all machines (a ``file:`` address or a bare path).
    """
    where = urlparse(shared_dir(spark))
    if where.scheme not in ("", "file"):
        raise ValueError("memory-mapped models need spark.checkpoint.dir on a mounted file system")
    folder = f"{where.path}/{name}-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def write_arrays(path: str, arrays: Iterable[np.ndarray]) -> None:
    """Write arrays behind each other into one file, at once: a task that runs twice leaves one whole file.

    Each starts at a multiple of eight bytes; where it starts and ends stands at the end of the file.
    """
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    places = []
    with open(part, "wb") as out:
        for array in arrays:
            start = out.tell()
            out.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
            places += [start, out.tell()]
            out.write(b"\0" * (-out.tell() % 8))
        out.write(np.array([*places, len(places)], np.int64).tobytes())
    os.replace(part, path)


class Maps:
    """Files of ``write_arrays`` mapped into memory; the ``most`` latest stay open."""

    def __init__(self, most: int):
        self.most = most
        self.open: OrderedDict[str, tuple[np.ndarray, np.ndarray] | None] = OrderedDict()

    def array(self, path: str, place: int, kind) -> np.ndarray:
        """The array at a place of a file; empty if there is no such file."""
        if path not in self.open:
            try:
                raw = np.asarray(np.memmap(path, np.uint8, "r"))
            except FileNotFoundError:
                self.open[path] = None
            else:
                n = int(raw[-8:].view(np.int64)[0])
                self.open[path] = raw, raw[-8 * (n + 1) : -8].view(np.int64)
            while len(self.open) > self.most:
                self.open.popitem(last=False)
        self.open.move_to_end(path)
        if self.open[path] is None:
            return np.empty(0, kind)
        raw, places = self.open[path]
        return raw[places[2 * place] : places[2 * place + 1]].view(kind)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that no later step computes them again."""
    return stored(df, name)
