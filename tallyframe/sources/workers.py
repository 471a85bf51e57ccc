"""Python workers of Arrow batches: how much they get at once, and what they give back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch to a Python worker, unless the session sets its own: texts are long, and memory is shared with the JVM.
BATCH = "4m"
#: What modules keep in a Python worker between tasks: (who keeps it, how it is given up).
_KEPT: list[tuple[str, Callable[[], object]]] = []
_slim: list[bool] = []


def kept_by(module: str, give_up: Callable[[], object]) -> None:
    """Has what a module keeps in a worker given up as soon as a task of another module runs there: workers outlive their tasks, and their memory is the executor's."""
    _KEPT.append((module, give_up))


def _libc(name: str, *args: int) -> None:
    try:
        getattr(ctypes.CDLL(None), name)(*args)
    except (AttributeError, OSError):  # another C library: its own way of giving memory back holds
        pass


def _settle(module: str) -> None:
    if not _slim:
        _slim.append(True)
        pa.set_memory_pool(pa.system_memory_pool())
        for option, value in ((-3, 1 << 22), (-1, 1 << 24), (-8, 1)):  # large blocks apart, freed ends given back, one arena
            _libc("mallopt", option, value)
    for owner, give_up in _KEPT:
        if owner != module:
            give_up()


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow() with batches of BATCH bytes, in workers that give back what they no longer need."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # the default
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    module = run.__module__

    def lean(batches):
        _settle(module)
        yield from run(batches)
        _libc("malloc_trim", 0)

    return df.mapInArrow(lean, schema)
