"""Averages of nested metric documents whose shape isn't known beforehand."""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose texts are Python objects at once.
SLICE = 256
_NUMBER = (bool, float)


def _unique(pairs: list[tuple]) -> dict:
    members = dict(pairs)
    if len(members) < len(pairs):
        raise ValueError("a key occurs twice")
    return members


def _no_constant(name: str) -> None:
    raise ValueError(name)


_JSON = json.JSONDecoder(object_pairs_hook=_unique, parse_int=float, parse_constant=_no_constant)


def _object(text: str | None) -> dict:
    """The JSON object that a text starts with, as try_parse_json reads it; empty for all else."""
    try:
        found = _JSON.raw_decode((text or "").lstrip(" \t\r\n"))[0]
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) else {}


def _segment(name: str) -> str:
    """A step of a JSON pointer."""
    return "/" + name.replace("~", "~0").replace("/", "~1")


def _level(item: dict) -> str:
    """An object's difficulty as a text."""
    v = item.get("difficulty")
    if v is None or isinstance(v, str):
        return "_none_" if v is None else v
    return format(Decimal(repr(v)).normalize(), "f") if isinstance(v, float) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _numbers(found: dict) -> Iterator[tuple[str, float]]:
    """(path, number) of an object, level by level, so that depth costs no stack."""
    todo = [("", found)]
    while todo:
        at, members = todo.pop()
        for key, v in members.items():
            path = at + _segment(key)
            if isinstance(v, _NUMBER):
                yield path, float(v)
            elif isinstance(v, dict):
                todo.append((path, v))
            elif isinstance(v, list) and v and isinstance(v[0], _NUMBER):
                yield from ((path, float(x)) for x in v if isinstance(x, _NUMBER))
            elif isinstance(v, list) and v and isinstance(v[0], dict):
                level = "difficulty" in v[0]
                todo += [(path + _segment(_level(x) if level else str(k)), x) for k, x in enumerate(v) if isinstance(x, dict)]


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in the last column: totals and counts of a batch by the other columns and path."""
    for batch in batches:
        sums: dict[tuple[str, str], list] = {}  # first row, total, count
        for lo in range(0, batch.num_rows, SLICE):
            *by, texts = (c.to_pylist() for c in batch.slice(lo, SLICE).columns)
            for k, text in enumerate(texts):
                group = repr([c[k] for c in by])
                for path, x in _numbers(_object(text)):
                    seen = sums.setdefault((group, path), [lo + k, 0.0, 0])
                    seen[1] += x
                    seen[2] += 1
        first, total, n = zip(*sums.values(), strict=True) if sums else ((), (), ())
        rows = pa.array(first, pa.int64())
        columns = [c.take(rows) for c in batch.columns[:-1]] + [pa.array([p for _, p in sums], pa.string()), pa.array(total, pa.float64()), pa.array(n, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "path", "total", "n"])


def nested_averages(documents: DataFrame, column: str, *by: str) -> DataFrame:
    """by, path, mean, total, n: the mean of every number in a column of JSON texts, by where it stands.

    Objects are taken apart until none is left, so paths (JSON pointers) and depth come from
    the data. Numbers in a list whose first element is one are pooled. Objects in a list whose first element
    is one are told apart by their `difficulty` if the first has that (`_none_` where one hasn't), else by
    their place. Truth values count as 1 and 0; texts, nulls and lists of other things don't count; a text
    that isn't a JSON object, or is null, has no numbers; rows that repeat count again. A text is parsed
    once, where it is read, and added up by path there, so what is shuffled are paths, not numbers.
    """
    keep = [*by, "path"]
    texts = documents.select(*by, F.col(column).cast("string").alias("__text"))
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in texts.schema.fields[:-1])
    each = texts.mapInArrow(_added_up, f"{types}path string, total double, n long")
    both = each.groupBy(*keep).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return both.select(*keep, F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.round("total", 6).alias("total"), "n")
