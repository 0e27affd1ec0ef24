"""Large JSON array files, read by many tasks and written by many.

Spark's text source cuts a file at every ``}`` (an ASCII byte, so any byte range can be read by itself).  What is a
closing brace and what is text depends on everything before it.  A file that is one split begins outside any string at
depth 0 and is cut at once.  Of the others:

1. every split gives its effect: whether it ends inside a string and how far the depth moves, for both cases of its
   beginning (one short row a split);
2. those effects are chained per file, which gives each split the state it begins in;
3. every split cuts itself into elements.  An element that lies over a boundary leaves a piece in each split; the
   pieces (at most two a split) are put together by file and place.

Elements are parsed with the declared schema.  Compressed files cannot be split and are read by one task each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# the splitting tasks travel by value: executors need numpy and pyarrow, not this library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_QUOTE, _SLASH = b'"', b"\\"
#: change of depth by byte; ``}`` is none of a chunk's bytes
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[]")] = 1, 1, -1
_MARK = bytes(k in b'"{[]' for k in range(256))
#: what stands between two elements
_BETWEEN = " \t\n\x0b\f\r,"


def _moves(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk (binary): whether its number of quotes is odd, and the change of depth if it begins outside and if it
    begins inside a string, with the ``}`` that follows it."""
    n = len(chunks)
    bounds = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset:chunks.offset + n + 1]
    data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    open_ = last[data[last] == _SLASH[0]]
    if len(open_):                      # a backslash stands for nothing of the next chunk
        data = data.copy()
        data[open_] = ord(" ")
    text = data.tobytes()
    if _SLASH in text:
        for c in (_SLASH, _QUOTE, b"{", b"[", b"]"):
            text = text.replace(_SLASH + c, b"  ")
    at = np.flatnonzero(np.frombuffer(text.translate(_MARK), np.bool_))
    kind = np.frombuffer(text, np.uint8)[at]
    chunk = np.repeat(np.arange(n), np.diff(np.searchsorted(at, bounds)))
    quote = kind == _QUOTE[0]
    quotes = np.bincount(chunk[quote], minlength=n)
    inside = (np.cumsum(quote) - quote - (np.cumsum(quotes) - quotes)[chunk]) % 2 == 1
    step, odd = _STEP[kind], quotes % 2 == 1
    plain, quoted = (np.bincount(chunk[k], step[k], minlength=n).astype(np.int64) for k in (~inside & ~quote, inside & ~quote))
    return odd, plain - ~odd, quoted - odd


def _walk(odd: np.ndarray, plain: np.ndarray, quoted: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each chunk ends inside a string, and the depth behind it, from the state before the first one."""
    ends_inside = (np.cumsum(odd) + inside) % 2 == 1
    return ends_inside, depth + np.cumsum(np.where(ends_inside ^ odd, quoted, plain))


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """``alone``: the split is its whole file."""
    m = F.col("_metadata")
    return (spark.read.option("lineSep", "}").text(path)
            .select(m["file_path"].alias("file"), m["file_block_start"].alias("block"),
                    (m["file_block_length"] >= m["file_size"]).alias("alone"), "value"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of one split at a time, and their chunks as bytes.  ``file`` may be any value that tells files apart."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file"), batch.column("block")
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            part = batch.slice(a, b - a)
            yield part, part.column("value").cast(pa.binary())


def _split_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: dict[tuple[str, int], list] = {}
    for part, chunks in _parts(batches):
        states = done.setdefault((part.column("file")[0].as_py(), part.column("block")[0].as_py()), [False, 0, True, 0])
        moves = _moves(chunks)
        for k in (0, 2):
            inside, depth = _walk(*moves, states[k], states[k + 1])
            states[k:k + 2] = bool(inside[-1]), int(depth[-1])
    rows = [(f, b, *s) for (f, b), s in done.items()]
    names = ["file", "block", "open_plain", "move_plain", "open_quoted", "move_quoted"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _beginnings(effects: DataFrame) -> DataFrame:
    """The state (quoted, depth) in which every split of a file begins."""
    def chain(table: pa.Table) -> pa.Table:
        quoted, depth, rows = False, 0, []
        for r in sorted(table.to_pylist(), key=lambda r: r["block"]):
            rows.append((r["file"], r["block"], quoted, depth))
            side = "quoted" if quoted else "plain"
            quoted, depth = r[f"open_{side}"], depth + r[f"move_{side}"]
        return pa.table({"file": [r[0] for r in rows], "block": [r[1] for r in rows], "quoted": [r[2] for r in rows],
                         "depth": pa.array([r[3] for r in rows], pa.int64())})
    return effects.groupBy("file").applyInArrow(chain, "file string, block long, quoted boolean, depth long")


def _joined(chunks: pa.Array, bounds: np.ndarray) -> pa.Array:
    """The chunks between every two bounds as one text, each with the ``}`` that follows it."""
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), chunks)
    return pc.binary_join_element_wise(pc.binary_join(lists, b"}"), b"}", b"")


def _cut(batches: Iterator[pa.RecordBatch], loose: bool) -> Iterator[pa.RecordBatch]:
    """Texts of whole elements, or (``loose``) the first and last pieces of splits that share their file (piece 0: up to
    the first end, 2: after the last).

    ``ends``: the text closes an element."""
    at, alone, inside, depth, ended, held = None, True, False, 0, False, []

    def out(texts: pa.Array, ends: bool, piece: int = 1) -> pa.RecordBatch:
        n, (file, block) = len(texts), at if loose else (None, None)
        columns = [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array([piece] * n, pa.int32()),
                   pa.array([ends] * n, pa.bool_()), texts]
        return pa.record_batch(columns, ["file", "block", "piece", "ends", "text"])

    def last() -> Iterator[pa.RecordBatch]:
        if held and loose != alone:
            yield out(pa.array([b"".join(held)]).view(pa.string()), False, 1 if alone else 2 if ended else 0)

    for part, chunks in _parts(batches):
        here = part.column("file")[0].as_py(), part.column("block")[0].as_py()
        if here != at:
            yield from last()
            at, alone, inside, depth = here, *(part.column(c)[0].as_py() for c in ("alone", "quoted", "depth"))
            ended, held = False, []
        ends_inside, depths = _walk(*_moves(chunks), inside, depth)
        inside, depth = bool(ends_inside[-1]), int(depths[-1])
        bounds = np.append(0, np.flatnonzero((depths == 1) & ~ends_inside) + 1)
        if len(bounds) > 1:
            begun = pa.array([b"".join([*held, _joined(chunks, bounds[:2])[0].as_py()])]).view(pa.string())
            if ended or alone:
                if not loose:
                    yield out(begun, True)
            elif loose:
                yield out(begun, True, 0)
            if not loose and len(bounds) > 2:
                yield out(pc.ascii_ltrim(_joined(chunks, bounds[1:]).view(pa.string()), _BETWEEN), True)
            ended, held = True, []
        if bounds[-1] < len(chunks):
            held.append(_joined(chunks, np.array([bounds[-1], len(chunks)]))[0].as_py())
    yield from last()


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of the objects in JSON array files, in any layout, with the declared schema.

    Elements that do not fit the schema become NULL fields, elements that are no objects are left out; text after a
    file's array is ignored, an empty file or array gives no row."""
    chunks = _chunks(spark, path)
    shared = chunks.where("NOT alone")
    effects = shared.mapInArrow(_split_effects, "file string, block long, open_plain boolean, move_plain long, open_quoted boolean, move_quoted long")
    # one short row for every split, that is for every task
    begun = F.broadcast(_beginnings(effects))
    kind = "file string, block long, piece int, ends boolean, text string"
    columns = ["block", "alone", "value", "quoted", "depth"]
    # the path is longer than most chunks and only read for loose pieces
    within = (chunks.join(begun, ["file", "block"], "left").select(F.xxhash64("file").alias("file"), *columns)
              .na.fill({"quoted": False, "depth": 0}).mapInArrow(lambda batches: _cut(batches, False), kind))
    loose = shared.join(begun, ["file", "block"]).select("file", *columns).mapInArrow(lambda batches: _cut(batches, True), kind)
    before = F.sum(F.col("ends").cast("int")).over(Window.partitionBy("file").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, -1))
    joined = (loose.withColumn("element", F.coalesce(before, F.lit(0)))
              .groupBy("file", "element").agg(F.array_sort(F.collect_list(F.struct("block", "piece", "text"))).alias("parts"),
                                              F.max("ends").alias("ends"))
              .select("ends", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")))
    whole = within.select("ends", "text").unionByName(joined)
    # nearly all texts begin with their element's brace: no pattern is needed for them
    plain = F.col("ends") & F.col("text").startswith("{")
    # what stands between two elements, the opening bracket, and behind the last element the closing one
    inner = F.regexp_replace(F.regexp_replace("text", r"^[\s,]*(?:\[[\s,]*)?", ""), r"^\][\s\S]*$", "")
    rest = F.regexp_replace(inner, r"\s*\}?\s*$", "")          # the mark that ends a file's last chunk is none of its text
    body = F.when(plain, F.col("text")).when(F.col("ends"), inner).otherwise(F.regexp_replace(rest, r"\]\s*$", ""))
    row = schema.simpleString() if isinstance(schema, StructType) else _struct_ddl(schema)
    text = F.concat(F.lit("["), "body", F.lit("]"))
    # other values may stand before an object; they are left out
    objects = F.filter(F.from_json(text, "array<string>"), lambda x: F.ltrim(x).startswith("{"))
    elements = F.when(F.col("body").startswith("{"), F.from_json(text, f"array<{row}>")).otherwise(
        F.transform(objects, lambda x: F.from_json(x, row)))
    listed = whole.select(body.alias("body")).where("body <> ''").select(F.explode(elements).alias("row"))
    return listed.where("row IS NOT NULL").select("row.*")


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a task as the lines of one JSON array."""
    mark = "["
    for batch in batches:
        if batch.num_rows:
            texts = batch.column(0)
            lines = pc.binary_join_element_wise(",", texts[1:], "")
            yield pa.record_batch([pa.concat_arrays([pc.binary_join_element_wise(mark, texts[:1], ""), lines])], ["value"])
            mark = ","
    yield pa.record_batch([pa.array(["]" if mark == "," else "[]"])], ["value"])


def write_json_array(df: DataFrame, path: str) -> str:
    """One JSON array a file, one file a task: nothing is shuffled or sorted for it."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(_array_lines, "value string").write.text(path)
    return path


def _struct_ddl(schema: str) -> str:
    """``struct<...>`` of a column list such as ``a long, b array<string>``."""
    return StructType.fromDDL(schema).simpleString()
