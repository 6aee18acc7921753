"""GeoJSON files read by many tasks.

A byte of JSON can only be understood with what stands before it: whether it lies in a string, and how deep. So every range of a file is first summed up as a function of how it begins: for either beginning (in a string or not) how it ends and by how much the
depth changes. The summaries, a few numbers a range, are added up in the order of a file's ranges; then each range knows its beginning, and gives the features that begin in it, reading on past its end for the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.sources.ranges import byte_ranges, file_of

RANGE_BYTES = 32 << 20
#: Read on by so much at a time, for the end of a feature.
STEP_BYTES = 1 << 20

_QUOTE, _ESCAPE = ord('"'), ord("\\")
_CHANGE = np.zeros(256, np.int8)
_CHANGE[[ord("{"), ord("[")]], _CHANGE[[ord("}"), ord("]")]] = 1, -1


def _read(path: str, start: int, until: int) -> bytes:
    system, place = file_of(path)
    with system.open_input_file(place) as f:
        return f.read_at(until - start, start)


def _escaped_start(path: str, start: int) -> bool:
    """Whether the byte at start is escaped: an odd run of backslashes stands before it."""
    n, low = 0, start
    while low > 0:
        low = max(0, low - 64)
        before = _read(path, low, start - n)
        run = len(before) - len(before.rstrip(b"\\"))
        n += run
        if run < len(before):
            break
    return n % 2 == 1


def _quotes(raw: np.ndarray, escaped: bool) -> np.ndarray:
    """Where quotes begin or end strings: those with an even run of backslashes before them."""
    at = np.flatnonzero(raw == _QUOTE)
    if not len(at):
        return at
    places = np.arange(len(raw))
    plain = np.where(raw != _ESCAPE, places, -1)
    last = np.concatenate([[-1], np.maximum.accumulate(plain)[:-1]])  # the last byte before that is no backslash
    run = at - 1 - last[at] + (escaped & (last[at] == -1))
    return at[run % 2 == 0]


def _depths(raw: np.ndarray, escaped: bool, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places and changes of depth outside strings, and whether the end lies in a string."""
    quotes = _quotes(raw, escaped)
    at = np.flatnonzero(_CHANGE[raw] != 0)
    outside = (np.searchsorted(quotes, at) + in_string) % 2 == 0
    at = at[outside]
    return at, _CHANGE[raw[at]].astype(np.int64), bool((len(quotes) + in_string) % 2)


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            raw, escaped = np.frombuffer(_read(r.path, r.start, r.until), np.uint8), _escaped_start(r.path, r.start)
            ends = [_depths(raw, escaped, begun) for begun in (False, True)]
            first = _read(r.path, 0, min(r.length, STEP_BYTES)).lstrip(b" \t\r\n")[:1].decode("latin-1") if r.start == 0 else ""
            rows.append((r.path, r.length, r.start, r.until, *(int(e[1].sum()) for e in ends), *(e[2] for e in ends), first))
        yield pd.DataFrame(rows, columns=["path", "length", "start", "until", "plain_depth", "string_depth", "plain_end", "string_end", "first"])


def _composed(found: DataFrame) -> DataFrame:
    """The beginning of each range: in_string and depth; and the depth of features: inside the root's arrays, or the root itself where it is one."""
    # A file's ranges, of some hundred bytes each, are put in order; its bytes aren't.
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # An odd number of quotes before it puts a range in a string.
    begun = found.withColumn("in_string", F.coalesce(F.sum(F.col("plain_end").cast("int")).over(before), F.lit(0)) % 2 == 1)
    own = F.when(F.col("in_string"), F.col("string_depth")).otherwise(F.col("plain_depth"))
    begun = begun.withColumn("depth", F.coalesce(F.sum(own).over(before), F.lit(0)))
    root = F.max("first").over(Window.partitionBy("path"))  # other ranges than the first have none
    return begun.select("path", "length", "start", "until", "in_string", "depth", F.when(root == "[", 1).otherwise(2).cast("long").alias("level"))


def _features(r: object) -> Iterator[bytes]:
    """The features that begin in a range."""
    raw = np.frombuffer(_read(r.path, r.start, r.until), np.uint8)
    escaped = _escaped_start(r.path, r.start)
    at, change, in_string = _depths(raw, escaped, r.in_string)
    depth = r.depth + np.cumsum(change)
    opens = at[(change > 0) & (depth == r.level + 1) & (raw[at] == ord("{"))]
    closes = at[(change < 0) & (depth == r.level)]
    whole = raw.tobytes()
    for begin in opens.tolist():
        before = whole[:begin].rstrip(b" \t\r\n")[-1:] if begin else b""
        if not before:  # the range begins with white space or the feature itself
            low = r.start
            while low > 0 and not before:
                low, high = max(0, low - 64), low
                before = _read(r.path, low, high).rstrip(b" \t\r\n")[-1:]
        if before == b":":  # an object's member, no element of an array
            continue
        k = np.searchsorted(closes, begin)
        if k < len(closes):
            yield whole[begin : int(closes[k]) + 1]
            continue
        # The last one goes on in what follows.
        parts, place, now, open_string, was = [whole[begin:]], r.until, int(depth[-1]), in_string, _ends_escaped(whole, escaped)
        while place < r.length:
            more = _read(r.path, place, min(place + STEP_BYTES, r.length))
            more_at, more_change, after = _depths(np.frombuffer(more, np.uint8), was, open_string)
            ends = more_at[now + np.cumsum(more_change) == r.level]
            if len(ends):
                yield b"".join([*parts, more[: int(ends[0]) + 1]])
                break
            parts.append(more)
            now, open_string, was, place = now + int(more_change.sum()), after, _ends_escaped(more, was), place + len(more)
    if r.start == 0 and r.level == 2 and not len(opens):
        yield from _root(r)


def _ends_escaped(raw: bytes, escaped: bool) -> bool:
    """Whether the byte after raw is escaped."""
    run = len(raw) - len(raw.rstrip(b"\\"))
    return (run + (escaped and run == len(raw))) % 2 == 1


def _root(r: object) -> Iterator[bytes]:
    """A file that is one feature: its beginning is looked through for the root's type, then it is read whole, as a feature is."""
    raw = np.frombuffer(_read(r.path, 0, min(r.length, max(r.until, STEP_BYTES))), np.uint8)
    at, change, _ = _depths(raw, False, False)
    quotes = _quotes(raw, False)
    depth = np.concatenate([[0], np.cumsum(change)])
    starts, ends = quotes[::2], quotes[1::2]
    level = depth[np.searchsorted(at, starts[: len(ends)])]
    texts = [raw[a + 1 : b].tobytes() for a, b, d in zip(starts.tolist(), ends.tolist(), level.tolist(), strict=False) if d == 1]
    if any(a == b"type" and b == b"Feature" for a, b in zip(texts, texts[1:], strict=False)):
        yield _read(r.path, 0, r.length)


def _given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pandas().itertuples():
            some, size = [], 0
            for feature in _features(r):
                some.append(feature)
                size += len(feature)
                if size > STEP_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string())], ["feature"])
                    some, size = [], 0
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string())], ["feature"])


def feature_texts(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The JSON of every object in the arrays of the files' roots, of every object of a root that is an array, and of roots that are features themselves.

    A task holds a range, one after another, and the end of its last feature.
    """
    ranges, tasks = byte_ranges(spark, path, range_bytes)
    summaries = ranges.mapInPandas(_summed, "path string, length long, start long, until long, plain_depth long, string_depth long, plain_end boolean, string_end boolean, first string")
    return _composed(summaries).repartition(tasks, "path", "start").mapInArrow(_given, "feature string")
