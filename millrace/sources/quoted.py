"""Large files of text whose quoted fields span lines, read by many tasks.

A line alone does not tell whether it starts inside quotes. It does tell how it ends for either start, and so does a
split for all its lines. A first pass asks every split, the driver follows the answers from the start of each file, and
the second pass cuts every split into records knowing how it starts. A record that goes on into later splits belongs to
the one where it starts; only these rests, one record for a split at most, pass through the driver. A field that the end
of its file leaves open is without the last line break.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .table import PLACE

# Workers that read files need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE, COMMA = ord('"'), ord(",")
#: What Spark's parser takes as white space.
BLANK = bytes(range(33))
Split = tuple[str, int]


def _skip(line: bytes, i: int) -> int:
    while i < len(line) and line[i] <= 32:
        i += 1
    return i


def ending(line: bytes, inside: bool) -> tuple[bool, bool]:
    """Whether a line ends inside a quoted field, from whether it starts in one, as Spark's parser has it; and whether some quoted field goes on after its end.

    A quote opens a field only at its start, doubled quotes stand for one, and a quote that no delimiter follows makes
    the rest of its field plain.
    """
    i, stray = 0, False
    while True:
        if not inside:
            i = _skip(line, i)
            if i == len(line):
                return False, stray
            if line[i] != QUOTE:
                i = line.find(b",", i) + 1
                if not i:
                    return False, stray
                continue
            i += 1
        i = line.find(b'"', i)
        if i < 0:
            return True, stray
        if line[i + 1 : i + 2] == b'"':
            inside, i = True, i + 2
            continue
        inside, i = False, _skip(line, i + 1)
        if i < len(line):
            stray = stray or line[i] != COMMA
            i = line.find(b",", i) + 1
            if not i:
                return False, stray


def ends_open(line: bytes, inside: bool) -> bool:
    return ending(line, inside)[0]


@dataclass
class Start:
    """How splits start: those inside a quoted field, and what later splits hold of a split's last record."""

    inside: set[Split] = field(default_factory=set)
    rests: dict[Split, bytes] = field(default_factory=dict)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Split, list[bytes]]]:
    """Lines that stand together in one split; a split may come as several runs."""
    for batch in batches:
        paths, starts = batch.column(1).dictionary_encode(), batch.column(2).to_numpy()
        codes = paths.indices.to_numpy()
        cuts = [0, *(((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])).nonzero()[0] + 1).tolist(), len(starts)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield (paths.dictionary[int(codes[a])].as_py(), int(starts[a])), batch.column(0).slice(a, b - a).to_pylist()


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split: how it ends from either start, and, if it starts outside, whether lines alone may be read otherwise than together."""
    key, ends = None, []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"path": [key[0]], "start": pa.array([key[1]], pa.int64()), "outside": [ends[0]], "inside": [ends[1]], "broken": [ends[2]]})

    for k, lines in _runs(batches):
        if k != key:
            if key is not None:
                yield told()
            key, ends = k, [False, True, False]
        for line in lines:
            met = ends[0] == ends[1]
            ends[0], stray = ending(line, ends[0])
            ends[1] = ends[0] if met else ends_open(line, ends[1])
            ends[2] = ends[2] or ends[0] or stray
    if key is not None:
        yield told()


def _rests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split, which starts inside quotes: its lines up to the end of that record, and whether it ends there."""
    held: dict[Split, list[bytes]] = {}
    closed: set[Split] = set()
    for k, lines in _runs(batches):
        for line in lines:
            if k in closed:
                break
            held.setdefault(k, []).append(line)
            if b'"' in line and not ends_open(line, True):
                closed.add(k)
    for k, lines in held.items():
        yield pa.RecordBatch.from_pydict({"path": [k[0]], "start": pa.array([k[1]], pa.int64()), "rest": pa.array([b"\n".join(lines)], pa.binary()), "closed": [k in closed]})


def starts(spark: SparkSession, path: str) -> Start | None:
    """How the splits of the files start; none if Spark may cut them at any line, as no quoted field spans lines."""
    lines = _lines(spark, path)
    # Lines without quotes end as they start.
    told = lines.where(F.contains("line", F.lit(b'"'))).mapInArrow(_ends, "path string, start long, outside boolean, inside boolean, broken boolean").collect()
    if not any(r.broken for r in told):
        return None
    ends = {(r.path, r.start): (r.outside, r.inside) for r in told}
    splits = sorted((r[0], r[1]) for r in lines.select(*PLACE).distinct().collect())
    out, open_after, file, inside = Start(), {}, None, False
    for s in splits:
        if s[0] != file:
            file, inside = s[0], False
        if inside:
            out.inside.add(s)
        inside = open_after[s] = ends.get(s, (False, True))[inside]
    if not out.inside:
        return out
    asked = [F.struct(F.lit(p).alias(PLACE[0]), F.lit(at).cast("long").alias(PLACE[1])) for p, at in sorted(out.inside)]
    rests = {(r.path, r.start): (bytes(r.rest), r.closed) for r in lines.where(F.struct(*PLACE).isin(asked)).mapInArrow(_rests, "path string, start long, rest binary, closed boolean").collect()}
    held: dict[Split, list[bytes]] = {}
    owner = None
    for s in splits:
        rest, closed = rests.get(s, (None, True))
        if rest is not None:
            held.setdefault(owner, []).append(rest)
        # A split that lies in one record as a whole starts none.
        if closed and open_after[s]:
            owner = s
    out.rests = {k: b"\n".join(v) for k, v in held.items()}
    return out


def records(spark: SparkSession, path: str, start: Start, header: bool, returns: set[str]) -> DataFrame:
    """Records as text with the file and split where they start, in the order of the scan; without blank ones and headers.

    A delimiter follows each, as the parser takes a field that ends with the text otherwise than one that a line ends.
    returns: files whose lines end with a carriage return as well, for which one line feed stands in quotes too.
    """
    # The rests may be large: they go to the executors once.
    shared = spark.sparkContext.broadcast((start.inside, start.rests))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, rests = shared.value
        key, held, skipping, headed = None, [], False, False

        def batch(k: Split, found: list[bytes]) -> pa.RecordBatch:
            nonlocal headed
            found = [x + b"," for x in found if x.strip(BLANK)]
            if headed and found:
                found, headed = found[1:], False
            n = len(found)
            return pa.RecordBatch.from_pydict({"record": pa.array(found, pa.binary()), PLACE[0]: pa.array([k[0]] * n, pa.string()), PLACE[1]: pa.array([k[1]] * n, pa.int64())})

        def whole(k: Split, lines: list[bytes]) -> bytes:
            out = b"\n".join(lines)
            return out.replace(b"\r\n", b"\n") if k[0] in returns else out

        def last() -> pa.RecordBatch:
            out = whole(key, [*held, *([rests[key]] if key in rests else [])])
            # Only the end of its file leaves a field open.
            return batch(key, [out + b'"' if ends_open(out, False) else out])

        for k, lines in _runs(batches):
            if k != key:
                if held:
                    yield last()
                key, held, skipping, headed = k, [], k in inside, header and k[1] == 0
            found = []
            for line in lines:
                if skipping:
                    skipping = b'"' not in line or ends_open(line, True)
                elif held:
                    held.append(line)
                    if b'"' in line and not ends_open(line, True):
                        found.append(whole(k, held))
                        held = []
                elif b'"' in line and ends_open(line, False):
                    held = [line]
                else:
                    found.append(line)
            yield batch(k, found)
        if held:
            yield last()

    return _lines(spark, path).mapInArrow(run, f"record binary, {PLACE[0]} string, {PLACE[1]} long")
