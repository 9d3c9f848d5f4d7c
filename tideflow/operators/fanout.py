"""One flow to several."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.flow import OrderedFlow
from tideflow.functions.hashing import fnv1a32
from tideflow.plans.ordered import clean, indexed


def partition(flow: OrderedFlow, predicate: Column) -> tuple[OrderedFlow, OrderedFlow]:
    """Rows for which the predicate is true, and the others."""
    yes = F.coalesce(predicate, F.lit(False))
    return flow.with_df(flow.df.where(yes)), flow.with_df(flow.df.where(~yes))


def broadcast(flow: OrderedFlow, n: int) -> list[OrderedFlow]:
    """n branches that compute the shared part once (kept in memory, spilled to disk). release() of any branch's flow gives the memory back."""
    if n < 2:
        raise ValueError("at least two branches")
    shared = flow.with_df(flow.df.persist(StorageLevel.MEMORY_AND_DISK))
    return [shared] * n


def share(flow: OrderedFlow) -> Callable[[], OrderedFlow]:
    """A function that gives any number of branches of one shared computation; release() of one gives the memory back."""
    shared = flow.with_df(flow.df.persist(StorageLevel.MEMORY_AND_DISK))
    return lambda: shared


def release(flow: OrderedFlow) -> None:
    """The branches of broadcast or share are done."""
    flow.df.unpersist()


@contextmanager
def shared(flow: OrderedFlow) -> Iterator[OrderedFlow]:
    """One shared computation for the block, released at its end."""
    kept = share(flow)()
    try:
        yield kept
    finally:
        release(kept)


def balance(flow: OrderedFlow, n: int, name: str = "branch") -> OrderedFlow:
    """Round robin: the branch is the position modulo n."""
    if n < 2:
        raise ValueError("at least two branches")
    return flow.with_df(clean(indexed(flow, "_idx").withColumn(name, (F.col("_idx") % n).cast("int")).drop("_idx")))


def keyed_balance(flow: OrderedFlow, n: int, key: str, name: str = "branch") -> OrderedFlow:
    """Rows of a key go to one branch, by the 32-bit FNV-1a hash of the key's text."""
    if n < 2:
        raise ValueError("at least two branches")
    return flow.with_df(flow.df.withColumn(name, F.pmod(fnv1a32(F.col(key).cast("string")), F.lit(n)).cast("int")))


def run_all(*actions: Callable[[], object], shared: DataFrame | None = None) -> list:
    """Several terminals in one run: the shared part is computed once, the actions run side by side."""
    if not actions:
        raise ValueError("nothing to run")
    if shared is not None:
        shared.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        with ThreadPoolExecutor(len(actions)) as pool:
            return [f.result() for f in [pool.submit(a) for a in actions]]
    finally:
        if shared is not None:
            shared.unpersist()
