"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir

# Words are what stands between blanks and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and lineage ends there."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts of at most 8 MB, unless the session asks for less: a worker holds several at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "67108864b") == "67108864b":
        spark.conf.set(name, "8m")


def give_back() -> None:
    """What Arrow's pool and the C library keep of freed memory goes back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    # Only some C libraries have it.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def given_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a task's work on its batches, with memory given back at the end, as a worker lives on beside later stages."""

    @functools.wraps(run)
    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        # What ``run`` held is gone here.
        give_back()

    return task


# Least seconds between two groups of a worker behind which memory is given back.
REST = 0.25


def given_back_by_group(run: Callable) -> Callable:
    """``run``, the work on one group of many, with memory given back now and then: no group knows that it is the last."""

    @functools.wraps(run)
    def group(key: tuple, rows: object) -> object:
        import time

        made, last = run(key, rows), process_cache("given_back", dict)
        if time.monotonic() - last.get("at", 0.0) > REST:
            give_back()
            last["at"] = time.monotonic()
        return made

    return group


def whole_text(column: str | Column = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words of a text as an array; no words for null."""
    return F.filter(F.split(whole_text(text), GAP, -1), lambda w: w != F.lit(""))


def process_cache(name: str, make: Callable[[], object]) -> object:
    """One object per Python worker process, kept from task to task.

    Functions of this package travel by value, so a module global would start
    empty in every task.
    """
    module = sys.modules.setdefault("quarry_worker_cache", types.ModuleType("quarry_worker_cache"))
    if not hasattr(module, name):
        setattr(module, name, make())
    return getattr(module, name)


def tokenizer(path: str) -> object:
    """Tokenizer read once per worker process, without threads of its own."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    known = process_cache("tokenizers", dict)
    if path not in known:
        known[path] = Tokenizer.from_file(path)
    return known[path]


# Steps that ``folded`` takes before it sets their rows aside.
PIECE = 256


def folded(steps: Column, at: Column, empty: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Struct of the last ``at`` and all ``rows`` of a fold whose ``step`` gives ``at`` and the ``rows`` with more behind.

    An array that grows is copied at every step. Here it grows for at most ``PIECE`` steps; the pieces are
    joined at the end, so that a fold of any length takes time in proportion to it.
    """
    start = lambda value: F.struct(value.alias("at"), empty.alias("rows"))

    def piece(done: Column, number: Column, every: Column) -> Column:
        part = F.aggregate(F.slice(every, number * PIECE + 1, F.lit(PIECE)), start(done["at"]), step)
        # Behind a transform the part is folded once, though it is used twice.
        return F.get(F.transform(F.array(part), lambda x: F.struct(x["at"].alias("at"), F.concat(done["parts"], F.array(x["rows"])).alias("parts"))), F.lit(0))

    def whole(every: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / PIECE).cast("int"))
        zero = F.struct(at.alias("at"), F.array(empty).alias("parts"))
        return F.aggregate(pieces, zero, lambda done, number: piece(done, number, every), lambda done: F.struct(done["at"].alias("at"), F.flatten(done["parts"]).alias("rows")))

    known = F.get(F.transform(F.array(steps), whole), F.lit(0))
    return F.when(F.size(steps) > 0, known).otherwise(start(at))


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that begin with an underscore under other names, and these names.

    The operators' own columns begin with an underscore, so that nothing in the input clashes with them.
    """
    taken = {c.lower() for c in docs.columns}
    free = (name for i in range(len(taken) * 2 + 1) if (name := f"aside{i}") not in taken)
    names = {c: next(free) for c in docs.columns if c.startswith("_")}
    return (docs.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in docs.columns]) if names else docs), names


def shielded(*outputs: str) -> Callable:
    """For an operator that returns the columns of its input and ``outputs``: other columns may have any name.

    A column of the input with the name of an output is replaced by it.
    """

    def wrap(operator: Callable) -> Callable:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **named) -> DataFrame:
            inner, names = set_aside(docs)
            if not names:
                return operator(docs, *args, **named)
            renamed = lambda x: names.get(x, x) if isinstance(x, str) else x
            out = operator(inner, *map(renamed, args), **{k: renamed(v) for k, v in named.items()})
            made = {o.lower() for o in outputs}
            own = [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns if c.lower() not in made]
            return out.select(*own, *outputs)

        return run

    return wrap


def selected(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``operator`` marks ``_kept``, with the columns of ``docs``, whatever their names."""
    inner, names = set_aside(docs)
    return operator(inner).where("_kept").select(*[F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns])
