"""One schema of many JSON texts: typed paths with counts, maps told from records, optional names, lengths of arrays.

Each text is parsed strictly (RFC 8259: no NaN, no control characters in strings,
nothing after the value) and shredded into observations (path, type, length),
which a task adds up in a tree of paths before they leave it.  Paths are arrays of
steps: the root, ".name" for a member, "[]" for an element.  One ``groupBy`` gives
a row a path.  Then the paths are gone through from the top: the least depth that
has an object path of more than ``most_names`` distinct names is rewritten (all its
names become ".*"), the rewritten rows are added up again, and the search goes on
below with what that gave.  Depths without a map cost no round.

Only one integer a round (the depth) comes to the driver, and nothing is broadcast:
rewriting joins on the path of the map, salted, as a map of many names owns many rows.

Edge cases: null texts, texts that are no object, and objects nested deeper than
``MOST_DEPTH`` (RFC 8259 lets a parser set a limit) count as ``bad`` at the row's own
path for such texts; repeated rows all count; of a name that an object repeats the
last value counts; a lone surrogate in a name is spelt as its escape; names with dots
or brackets stay apart from nested ones, though their paths read alike; an integer
has no point and no exponent, whatever its length; an empty table gives no rows; a
null client_id counts as 0, a null click_id as empty and not divisible by 9; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json import JSONDecodeError

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table

TYPES = ("array", "bad", "boolean", "double", "integer", "null", "object", "string")
ARRAY, BAD, OBJECT = TYPES.index("array"), TYPES.index("bad"), TYPES.index("object")
_TYPE_OF = {list: ARRAY, bool: TYPES.index("boolean"), float: TYPES.index("double"), int: TYPES.index("integer"), type(None): TYPES.index("null"), dict: OBJECT, str: TYPES.index("string")}
ROOT, ELEMENT, ANY = "$", "[]", ".*"
MOST_NAMES, MOST_DEPTH = 5, 500
#: Paths that a task holds before it hands its sums on; parts into which the rows of a map are split.
HELD_PATHS, SALTS = 100_000, 16
_COUNTS = [f"n_{t}" for t in TYPES]
OBSERVATION = "steps array<string>, " + ", ".join(f"{c} long" for c in _COUNTS) + ", min_len long, max_len long"


class _Path:
    """What was seen at a path, and the paths below it."""

    __slots__ = ("counts", "element", "least", "most", "names")

    def __init__(self) -> None:
        self.counts = [0] * len(TYPES)
        self.names: dict[str, _Path] = {}
        self.element: _Path | None = None
        self.least = self.most = None


def _refuse(constant: str) -> None:
    raise JSONDecodeError(f"{constant} is no JSON", constant, 0)


_decode = json.JSONDecoder(parse_constant=_refuse).decode
#: Integers of more digits than int() takes: only their type is asked for.
_decode_long = json.JSONDecoder(parse_constant=_refuse, parse_int=lambda digits: 0).decode


def _too_deep(text: str) -> bool:
    if text.count("[") + text.count("{") <= MOST_DEPTH:
        return False
    depth, quoted, k = 0, False, 0
    while k < len(text):
        c = text[k]
        if c == "\\" and quoted:
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            depth += (c in "[{") - (c in "]}")
            if depth > MOST_DEPTH:
                return True
        k += 1
    return False


def parsed(text: str | None) -> dict | None:
    """The object that the whole text is, or None."""
    if text is None or _too_deep(text):
        return None
    try:
        value = _decode(text)
    except JSONDecodeError:
        return None
    except ValueError:  # int() has a limit
        try:
            value = _decode_long(text)
        except JSONDecodeError:
            return None
    return value if type(value) is dict else None


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the observations of the rows (text, at, listed, bad_at), for ``HELD_PATHS`` paths at a time."""
    root, bad, held = _Path(), {}, 0

    def observe(path: _Path, value: object) -> None:
        nonlocal held
        todo = [(path, value)]
        while todo:
            path, value = todo.pop()
            kind = _TYPE_OF[type(value)]
            path.counts[kind] += 1
            if kind == OBJECT:
                names = path.names
                for name, v in value.items():
                    below = names.get(name)
                    if below is None:
                        below = names[name] = _Path()
                        held += 1
                    todo.append((below, v))
            elif kind == ARRAY:
                n = len(value)
                if path.most is None:
                    path.least = path.most = n
                elif n < path.least:
                    path.least = n
                elif n > path.most:
                    path.most = n
                if n and path.element is None:
                    path.element = _Path()
                    held += 1
                todo.extend((path.element, v) for v in value)

    def sums() -> Iterator[pa.RecordBatch]:
        rows: list[tuple[list[str], _Path]] = []
        todo = [([ROOT], root)] if any(root.counts) else []
        for label, n in bad.items():
            path = _Path()
            path.counts[BAD] = n
            todo.append(([label], path))
        while todo:
            steps, path = todo.pop()
            rows.append((steps, path))
            todo.extend(([*steps, "." + name.encode("utf-8", "backslashreplace").decode()], below) for name, below in path.names.items())
            if path.element is not None:
                todo.append(([*steps, ELEMENT], path.element))
            if len(rows) >= 5_000 or not todo:
                counts = zip(*(p.counts for _, p in rows), strict=True)
                columns = [pa.array([s for s, _ in rows], pa.list_(pa.string())), *(pa.array(c, pa.int64()) for c in counts), pa.array([p.least for _, p in rows], pa.int64()), pa.array([p.most for _, p in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["steps", *_COUNTS, "min_len", "max_len"])
                rows = []

    for batch in batches:
        for text, at, listed, bad_at in zip(*(batch.column(c).to_pylist() for c in ("text", "at", "listed", "bad_at")), strict=True):
            value = parsed(text)
            if value is None:
                bad[bad_at] = bad.get(bad_at, 0) + 1
                continue
            path = root
            for name in at:
                path.counts[OBJECT] += 1
                below = path.names.get(name)
                if below is None:
                    below = path.names[name] = _Path()
                    held += 1
                path = below
            observe(path, [value] if listed else value)
        if held + len(bad) >= HELD_PATHS:
            yield from sums()
            root, bad, held = _Path(), {}, 0
    yield from sums()


def _added(observations: DataFrame) -> DataFrame:
    """A row a path."""
    return observations.groupBy("steps").agg(*[F.sum(c).alias(c) for c in _COUNTS], F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"))


def observations(rows: DataFrame) -> DataFrame:
    """steps, counts of values by type, least and greatest length of arrays: a row a path of the rows (text, at, listed, bad_at)."""
    return _added(rows.select("text", "at", "listed", "bad_at").mapInArrow(_shred, OBSERVATION))


def _last() -> Column:
    return F.element_at("steps", -1)


def _parent() -> Column:
    return F.slice("steps", 1, F.size("steps") - 1)


def _members(paths: DataFrame) -> DataFrame:
    """The paths that are a name within an object."""
    return paths.filter((F.size("steps") > 1) & _last().startswith("."))


def _salted(salt: Column) -> Column:
    return F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")


def _rewritten(paths: DataFrame, maps: DataFrame, depth: int) -> DataFrame:
    """paths whose step after a map, a path of ``depth`` steps, is any name."""
    inside = (F.size("steps") > depth) & F.coalesce(F.get("steps", F.lit(depth)).startswith("."), F.lit(False))
    marked = maps.select(F.col("steps").alias("map"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).hint("merge")
    keyed = paths.filter(inside).withColumn("prefix", F.slice("steps", 1, depth)).withColumn("of_salt", _salted(F.col("steps")))
    joined = keyed.join(marked, (F.col("prefix") == F.col("map")) & (F.col("of_salt") == F.col("salt")), "left")
    renamed = F.concat("prefix", F.array(F.lit(ANY)), F.slice("steps", depth + 2, F.greatest(F.size("steps") - depth - 1, F.lit(0))))
    moved = joined.withColumn("steps", F.when(F.col("map").isNotNull(), renamed).otherwise(F.col("steps"))).select(*paths.columns)
    return _added(paths.filter(~inside).unionByName(moved))


def infer(rows: DataFrame, most_names: int = MOST_NAMES) -> DataFrame:
    """path, types, n_names, is_map, optional, min_len, max_len of the JSON objects in rows.

    rows has text, at (names of the objects that hold the row's value, outermost
    first), listed (whether the value stands in an array of its own) and bad_at (the
    path at which a text that is no object counts).  The root is never a map.
    """
    paths, depth, found = stored(observations(rows), "paths"), 1, []
    while True:
        names = _members(paths).groupBy(_parent().alias("steps")).agg(F.count("*").alias("map_names"))
        ahead = stored(names.filter((F.col("map_names") > most_names) & (F.size("steps") > depth)), "maps")
        depth = ahead.agg(F.min(F.size("steps"))).first()[0]
        if depth is None:
            break
        maps = ahead.filter(F.size("steps") == depth)
        found.append(maps)
        paths = stored(_rewritten(paths, maps, depth), "paths")
    return _report(paths, found)


def _report(paths: DataFrame, maps: list[DataFrame]) -> DataFrame:
    facts = paths.unionByName(_members(paths).select(_parent().alias("steps"), F.lit(1).cast("long").alias("names")), allowMissingColumns=True)
    for m in maps:
        facts = facts.unionByName(m, allowMissingColumns=True)
    if not maps:
        facts = facts.withColumn("map_names", F.lit(None).cast("long"))
    sums = [F.sum(c).alias(c) for c in (*_COUNTS, "names")]
    rows = facts.groupBy("steps").agg(*sums, F.max("map_names").alias("map_names"), F.min("min_len").alias("min_len"), F.max("max_len").alias("max_len"))
    rows = stored(rows, "facts")
    # Only the root may have any number of names that stay apart: its members are dealt over salts.
    at_root = F.size("steps") == 1
    parents = rows.filter(F.col("n_object") > 0).select(F.col("steps").alias("parent"), F.col("n_object").alias("objects"), F.explode(F.when(at_root, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    total = sum((F.col(c) for c in _COUNTS), F.lit(0))
    keyed = rows.withColumn("of", F.when(F.size("steps") > 1, _parent())).withColumn("of_salt", F.when(F.size("of") == 1, _salted(F.col("steps"))).otherwise(0))
    joined = keyed.join(parents.hint("merge"), (F.col("of") == F.col("parent")) & (F.col("of_salt") == F.col("salt")), "left")
    types = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{t}:"), F.col(c))) for t, c in zip(TYPES, _COUNTS, strict=True)])), "|")
    named = _last().startswith(".") & (_last() != ANY)
    return joined.select(
        F.array_join("steps", "").alias("path"),
        types.alias("types"),
        F.coalesce("map_names", "names", F.lit(0)).cast("long").alias("n_names"),
        F.col("map_names").isNotNull().alias("is_map"),
        F.coalesce(named & (total < F.col("objects")), F.lit(False)).alias("optional"),
        "min_len",
        "max_len",
    )


def click_rows(clicks: DataFrame) -> DataFrame:
    """clicks as rows of ``infer``: props under the names of their client's group and of a share of it."""
    group = F.pmod(F.coalesce(F.col("client_id").cast("long"), F.lit(0)), F.lit(200))
    number = F.col("click_id").cast("long")
    part = F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary")) % (group % 37 + 1)
    name = F.concat(F.lit("g"), group)
    listed = F.coalesce(number % 9 == 0, F.lit(False))
    return clicks.select(F.col("props").cast("string").alias("text"), F.array(name, F.concat(F.lit("x"), part)).alias("at"), listed.alias("listed"), F.concat(F.lit("!"), name).alias("bad_at"))


def op11_nested_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer(click_rows(table(spark, sf_dir, "clicks")))
