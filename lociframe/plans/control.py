"""Control around plans: safe calls, timing, memos, provenance, named checkpoints, and the steps of a plan."""

from __future__ import annotations

import functools
import html
import inspect
import os
import random
import resource
import string
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import ExitStack, contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession


def try_call(fn: Callable) -> dict:
    try:
        return {"ok": True, "value": fn(), "error": None}
    except Exception as e:
        return {"ok": False, "value": None, "error": str(e)}


def try_catch(fn: Callable, otherwise: Callable):
    """fn's value, or what otherwise makes of the error."""
    try:
        return fn()
    except Exception as e:
        return otherwise(e)


def retry(fn: Callable, times: int = 3, wait: float = 0.0):
    """Calls fn until it raises nothing, at most so many times; the last error goes on."""
    for left in reversed(range(times)):
        try:
            return fn()
        except Exception:
            if not left:
                raise
            time.sleep(wait)
    raise ValueError("times must be 1 or more")


@contextmanager
def defer(*jobs: Callable):
    """Runs the jobs when the block ends, the last first, whatever happens in it."""
    with ExitStack() as stack:
        for job in jobs:
            stack.callback(job)
        yield


def guard(test: bool, message: str = "guard") -> None:
    if not test:
        raise ValueError(message)


def assert_(test: bool, message: str) -> None:
    if not test:
        raise AssertionError(message)


def error(message: str) -> None:
    raise RuntimeError(message)


def pipe_fuse(steps: list, *_) -> list:
    """The steps as they are: Catalyst fuses a plan's steps itself."""
    return steps


def for_each(df: DataFrame, fn: Callable) -> DataFrame:
    """Calls fn with each row, partition by partition, on the executors."""
    df.foreach(fn)
    return df


parallel_for = for_each


def gen_int(low: int = -1000, high: int = 1000, seed: int | None = None) -> Callable[[], int]:
    draw = random.Random(seed)
    return lambda: draw.randint(low, high)


def gen_float(low: float = 0.0, high: float = 1.0, seed: int | None = None) -> Callable[[], float]:
    draw = random.Random(seed)
    return lambda: draw.uniform(low, high)


def gen_str(length: int = 10, alphabet: str = string.ascii_lowercase, seed: int | None = None) -> Callable[[], str]:
    draw = random.Random(seed)
    return lambda: "".join(draw.choices(alphabet, k=length))


def prop_test(prop: Callable, gen: Callable, n: int = 100) -> dict:
    """Whether prop holds for n drawn values, and the first for which it does not."""
    for i in range(n):
        value = gen()
        if not prop(value):
            return {"passed": False, "runs": i + 1, "counterexample": value}
    return {"passed": True, "runs": n, "counterexample": None}


def memory_usage() -> int:
    """The driver's largest resident size so far, in bytes."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


def env(name: str) -> str | None:
    return os.environ.get(name)


def cwd() -> str:
    return os.getcwd()


def sleep(seconds: float) -> None:
    time.sleep(seconds)


def exit_(code: int = 0) -> None:
    raise SystemExit(code)


def print_(*values) -> str:
    """Prints the values, tables by their first rows, and returns the text."""
    text = " ".join(v._show_string(20, 20, False) if isinstance(v, DataFrame) else str(v) for v in values)
    print(text, end="")
    return text


def println(*values) -> str:
    return print_(*values, "\n")


def debug(x):
    """Prints a table's schema, or a value's kind, and returns it."""
    print(x.schema.simpleString() if isinstance(x, DataFrame) else f"{type(x).__name__}: {x!r}")
    return x


def help_(fn: Callable) -> str:
    return f"{fn.__name__}{inspect.signature(fn)}\n{inspect.getdoc(fn) or ''}".rstrip()


def doctor(spark: SparkSession) -> dict[str, str]:
    """What a session runs on: versions, master, the shared folder, parallelism."""
    sc = spark.sparkContext
    return {"spark": spark.version, "python": sc.pythonVer, "master": sc.master, "parallelism": str(sc.defaultParallelism), "checkpoint": spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or "unset"}


def config(spark: SparkSession, key: str | None = None):
    """One setting of the session, or all of them."""
    return spark.conf.get(key, None) if key else {k: v for k, v in spark.conf.getAll.items()}


def memoize(fn: Callable) -> Callable:
    return functools.cache(fn)


def once(fn: Callable) -> Callable:
    """Runs fn at its first call only."""
    got: list = []

    @functools.wraps(fn)
    def run(*args, **kw):
        if not got:
            got.append(fn(*args, **kw))
        return got[0]

    return run


def time_it(fn: Callable) -> Callable:
    """fn with its seconds: (value, seconds)."""

    @functools.wraps(fn)
    def run(*args, **kw):
        began = time.perf_counter()
        return fn(*args, **kw), time.perf_counter() - began

    return run


def bench(fn: Callable, args: tuple = (), n: int = 10) -> dict[str, float]:
    took = []
    for _ in range(n):
        began = time.perf_counter_ns()
        fn(*args)
        took.append(time.perf_counter_ns() - began)
    return {"mean_ns": sum(took) / n, "min_ns": min(took), "max_ns": max(took), "iterations": n}


def await_all(jobs: list[Callable], threads: int = 8) -> list:
    """Runs independent jobs at the same time, results in order."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]


def par_map(items: list, fn: Callable, threads: int = 8) -> list:
    return await_all([functools.partial(fn, x) for x in items], threads)


def par_filter(items: list, fn: Callable, threads: int = 8) -> list:
    return [x for x, keep in zip(items, par_map(items, fn, threads), strict=True) if keep]


def with_provenance(df: DataFrame, **meta) -> DataFrame:
    """Notes on the first column's metadata: when, from what."""
    c = df.columns[0]
    note = {"timestamp": datetime.now(UTC).isoformat(), **{k: str(v) for k, v in meta.items()}}
    return df.withMetadata(c, {**df.schema[c].metadata, "provenance": [*df.schema[c].metadata.get("provenance", []), note]})


def provenance(df: DataFrame) -> dict | None:
    notes = provenance_chain(df)
    return notes[-1] if notes else None


def provenance_chain(df: DataFrame) -> list[dict]:
    return list(df.schema[0].metadata.get("provenance", [])) if df.columns else []


def checkpoint(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df under a name and goes on with what was written."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return resume_checkpoint(df.sparkSession, folder, name)


def resume_checkpoint(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def pipeline_steps(df: DataFrame) -> list[str]:
    """Operators of the optimised plan, from the source up."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    return [x.lstrip(" :+-").split(" ")[0] for x in reversed(lines) if x.strip()]


def sparkline(values: list[float]) -> str:
    bars = "▁▂▃▄▅▆▇█"
    low, high = min(values), max(values)
    return "".join(bars[int((v - low) / ((high - low) or 1) * 7)] for v in values)


def bar_chart(rows: list[tuple[str, float]], width: int = 40) -> str:
    top = max(v for _, v in rows) or 1
    wide = max(len(k) for k, _ in rows)
    return "\n".join(f"{k.ljust(wide)} {'█' * round(v / top * width)} {v:g}" for k, v in rows)


def to_markdown(df: DataFrame, rows: int = 50) -> str:
    got = df.limit(rows).collect()
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got)])


def to_html(df: DataFrame, rows: int = 50) -> str:
    cells = lambda r, tag: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in r) + "</tr>"
    return "<table>" + cells(df.columns, "th") + "".join(cells(r, "td") for r in df.limit(rows).collect()) + "</table>"


def write_markdown(df: DataFrame, path: str, rows: int = 50) -> str:
    return _saved(to_markdown(df, rows) + "\n", path)


def write_html(df: DataFrame, path: str, rows: int = 50) -> str:
    return _saved(to_html(df, rows) + "\n", path)


def _saved(text: str, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path
