"""Nearest smaller values and greedy cuts over groups of any size and levels of any depth.

Both are folds by nature: a stack, or a loop that restarts where it stopped. Here rows are sorted into ranges by (group,
order) and each range is folded by itself; what a range leaves for the others is small (the open end of its stack, at most a row
a level; the exits of its pointers) and is put together a group at a time. No task holds a group, only a range.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.operators.ordered import placed, summed
from lectern.sources.folders import work_dir


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as a table of the library's own and read again."""
    path = f"{work_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folded(rows: DataFrame, keys: list[Column], fold, more: list[T.StructField], what: str) -> DataFrame:
    """rows in sorted ranges with ``_part`` and the columns that fold makes of a whole range, written."""
    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.LongType()), *more])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        columns = [*t.columns, pa.array(np.full(t.num_rows, TaskContext.get().partitionId())), *fold(t)]
        yield from pa.Table.from_arrays(columns, names=schema.names).cast(arrow).to_batches(1 << 16)

    return written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema), what)


def _starts(t: pa.Table, group: str) -> np.ndarray:
    """Where in a sorted range each group begins, and the range's end."""
    codes = t.column(group).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate((np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))), [len(codes)]))


def nearest(rows: DataFrame, group: str, order: list[Column | str], level: str, value: str, name: str, after: bool = False, equal: bool = False) -> DataFrame:
    """With ``name``: ``value`` of the nearest row before this one (or after it) in its group whose level is smaller (or
    equal); null where there is none. Rows without a level have none and are nobody's."""
    plain = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [F.col("_g"), *[F.col(f"_o{i}").desc() if after else F.col(f"_o{i}") for i in range(len(plain))]]
    d = rows.select("*", F.col(group).alias("_g"), *[o.alias(f"_o{i}") for i, o in enumerate(plain)], F.col(level).cast("double").alias("_l"), F.col(value).alias("_v"))

    def fold(t: pa.Table) -> list[pa.Array]:
        levels, at = t.column("_l").to_numpy(), np.full(t.num_rows, -1)
        asks, stays, edge = np.zeros(t.num_rows, bool), np.zeros(t.num_rows, bool), _starts(t, "_g")
        for a, z in zip(edge.tolist(), edge[1:].tolist()):
            stack: list[int] = []
            for i, x in enumerate(levels[a:z].tolist(), a):
                if x != x:
                    continue
                while stack and (levels[stack[-1]] > x or not equal and levels[stack[-1]] == x):
                    stack.pop()
                if stack:
                    at[i] = stack[-1]
                else:
                    asks[i] = True
                if stack and levels[stack[-1]] == x:
                    stack.pop()
                stack.append(i)
            stays[stack] = True
        found = t.column("_v").combine_chunks().take(pa.array(at, mask=at < 0))
        return [found, pa.array(asks), pa.array(stays)]

    kind = d.schema["_v"].dataType
    done = _folded(d, keys, fold, [T.StructField("_found", kind), T.StructField("_asks", T.BooleanType()), T.StructField("_stays", T.BooleanType())], "nearest")
    # Only groups that reach over more than one range leave questions, a row a level and range.
    several = done.groupBy("_g").agg(F.min("_part").alias("_a"), F.max("_part").alias("_z")).where("_a < _z").select(F.col("_g").alias("_s"))
    wide = done.where("_asks OR _stays").join(several, F.col("_g").eqNullSafe(F.col("_s")), "left_semi")
    asked = wide.where("_asks").select("_g", "_part", "_l", F.lit(None).cast(kind).alias("_v"), F.lit(True).alias("_q")).distinct()
    open_ = wide.where("_stays").select("_g", "_part", "_l", "_v", F.lit(False).alias("_q"))
    out = T.StructType([T.StructField("_g2", d.schema["_g"].dataType), T.StructField("_part2", T.LongType()), T.StructField("_l2", T.DoubleType()), T.StructField("_far", kind)])
    arrow = to_arrow_schema(out)

    def merge(t: pa.Table) -> pa.Table:
        """Ranges in order: answer by the stack so far, then put the range's own open end on it."""
        levels: list[float] = []
        values, answers = [], []
        rows_ = sorted(zip(t.column("_part").to_pylist(), [not q for q in t.column("_q").to_pylist()], t.column("_l").to_pylist(), range(t.num_rows)))
        last, value = None, t.column("_v").to_pylist()
        for part, opens, x, i in rows_:
            if opens:
                if (part, True) != last:  # the first of a range's stack is its least level
                    cut = bisect_left(levels, x)
                    del levels[cut:], values[cut:]
                levels.append(x)
                values.append(value[i])
            else:
                at = (bisect_right if equal else bisect_left)(levels, x) - 1
                if at >= 0:
                    answers.append((part, x, values[at]))
            last = (part, opens)
        g = t.column("_g")[0].as_py() if t.num_rows else None
        return pa.Table.from_pylist([{"_g2": g, "_part2": p, "_l2": x, "_far": v} for p, x, v in answers], schema=arrow)

    far = asked.unionByName(open_).groupBy("_g").applyInArrow(merge, out)
    on = F.col("_asks") & F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_part") == F.col("_part2")) & (F.col("_l") == F.col("_l2"))
    return done.join(far, on, "left").select(*rows.columns, F.coalesce("_found", "_far").alias(name))


def parents(heads: DataFrame, key: str, order: str = "line", level: str = "level") -> DataFrame:
    """With ``parent``: the order of the nearest earlier row of a smaller level, whatever the levels."""
    return nearest(heads, key, [order], level, order, "parent")


def subtree_end(heads: DataFrame, key: str, order: str = "line", level: str = "level") -> DataFrame:
    """With ``until``: the order of the next row that is not below this one (null: to the end)."""
    return nearest(heads, key, [order], level, order, "until", after=True, equal=True)


def descendants(heads: DataFrame, key: str, order: str = "line", level: str = "level") -> DataFrame:
    """With ``descendants``: how many rows stand below each, from its place and that of the next one not below it."""
    d = placed(heads, [key], [order], "_place", count="_all")
    ends = nearest(d, key, [order], level, "_place", "_until", after=True, equal=True)
    return ends.withColumn("descendants", F.coalesce("_until", "_all") - F.col("_place") - 1).drop("_place", "_all", "_until")


def next_beyond(rows: DataFrame, group: str, place: str, reach: str, bound: str) -> DataFrame:
    """rows(group, place, reach, bound) with ``to``: the first place whose reach is over this row's bound, after this one.
    ``reach`` grows with the place; null where no place is."""
    point = rows.select(group, F.col(reach).cast("double").alias("_x"), F.col(place).alias("_p"), F.lit(0).alias("_kind"))
    ask = rows.where(F.col(bound).isNotNull()).select(group, F.col(bound).cast("double").alias("_x"), F.col(place).alias("_p"), F.lit(1).alias("_kind"))
    found = nearest(point.unionByName(ask), group, ["_x", "_kind", "_p"], "_kind", "_p", "_to", after=True).where("_kind = 1")
    back = found.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), "_to")
    j = rows.join(back, F.col(group).eqNullSafe(F.col("_g")) & (F.col(place) == F.col("_q")), "left")
    return j.select(*rows.columns, F.when(F.col("_to").isNotNull(), F.greatest("_to", F.col(place) + 1)).alias("to"))


def path(rows: DataFrame, group: str, place: str, to: str) -> DataFrame:
    """Those of rows(group, place, to) that are met from place 0 of their group by going to ``to`` again and again.

    Places are 0, 1, ... in each group and pointers go forward. A range doubles its pointers until all leave it, so each
    of its rows knows where a walk that comes by goes on; only rows that others' exits name, and places 0, are joined and
    walked a group at a time; then each range marks the walk from where it enters."""
    d = rows.withColumn("_g", F.col(group)).withColumn("_p", F.col(place).cast("long")).withColumn("_t", F.col(to).cast("long"))

    def fold(t: pa.Table) -> list[pa.Array]:
        p, goes = t.column("_p").to_numpy(), t.column("_t").to_pandas().fillna(-1).to_numpy(np.int64)
        edge = _starts(t, "_g")
        first = np.repeat(edge[:-1], np.diff(edge))
        low, high = p[first], p[np.repeat(edge[1:] - 1, np.diff(edge))]
        out = goes.copy()
        inside = np.flatnonzero((out >= 0) & (out <= high))
        while len(inside):  # a pointer into the range takes over that row's pointer
            out[inside] = out[first[inside] + out[inside] - low[inside]]
            inside = inside[(out[inside] >= 0) & (out[inside] <= high[inside])]
        return [pa.array(out, mask=out < 0)]

    done = _folded(d, [F.col("_g"), F.col("_p")], fold, [T.StructField("_exit", T.LongType())], "pointers")
    entries = done.where("_exit IS NOT NULL").select(F.col("_g").alias("_eg"), F.col("_exit").alias("_ep")).distinct()
    met = done.join(entries, F.col("_g").eqNullSafe(F.col("_eg")) & (F.col("_p") == F.col("_ep")), "left_semi").unionByName(done.where("_p = 0")).select("_g", "_part", "_p", "_exit").distinct()
    out = to_arrow_schema(T.StructType([T.StructField("_part", T.LongType()), T.StructField("_g", d.schema["_g"].dataType), T.StructField("_p", T.LongType())]))

    def walk(t: pa.Table) -> pa.Table:
        known = {p: (part, e) for p, part, e in zip(*(t.column(c).to_pylist() for c in ("_p", "_part", "_exit")))}
        at, g, entered = 0, t.column("_g")[0].as_py(), []
        while at is not None and at in known:
            part, then = known[at]
            entered.append({"_part": part, "_g": g, "_p": at})
            at = then
        return pa.Table.from_pylist(entered, schema=out)

    entered = met.groupBy("_g").applyInArrow(walk, T.StructType([T.StructField("_part", T.LongType()), T.StructField("_g", d.schema["_g"].dataType), T.StructField("_p", T.LongType())]))
    cols = [F.col(c) for c in done.columns]
    names = rows.columns
    result = T.StructType([T.StructField(c, done.schema[c].dataType) for c in names])

    def mark(t: pa.Table, starts: pa.Table) -> pa.Table:
        t = t.sort_by([("_g", "ascending"), ("_p", "ascending")])
        edge = _starts(t, "_g")
        p, goes = t.column("_p").to_pylist(), t.column("_t").to_pylist()
        where = {g: (a, z) for g, a, z in zip([t.column("_g")[a].as_py() for a in edge[:-1].tolist()], edge.tolist(), edge[1:].tolist())}
        on = np.zeros(t.num_rows, bool)
        for g, at in zip(starts.column("_g").to_pylist(), starts.column("_p").to_pylist()):
            a, z = where[g]
            i = a + at - p[a]
            while i < z:
                on[i] = True
                if goes[i] is None:
                    break
                i = a + goes[i] - p[a]
        return t.filter(pa.array(on)).select(names)

    return done.select(*cols).groupBy("_part").cogroup(entered.groupBy("_part")).applyInArrow(mark, result)


def size_batches(items: DataFrame, group: str, order: list[Column | str], size: str, most: int) -> DataFrame:
    """(group, batch, first, end): items in order in batches that hold at most ``most``, one item at least; places from 0."""
    d = summed(placed(items.select(group, *[o for o in order if isinstance(o, str)], F.coalesce(size, F.lit(0)).alias("_n")), [group], order), [group], ["place"], "_n", "_before")
    d = d.select(group, "place", (F.col("_before") + F.col("_n")).alias("_reach"), (F.col("_before") + most).alias("_bound"))
    return _cuts(next_beyond(d, group, "place", "_reach", "_bound"), group, "batch")


def _cuts(pointers: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name, first, end) of a walk whose steps are the groups; the last ends with the places."""
    last = pointers.groupBy(F.col(group).alias("_g")).agg((F.max("place") + 1).alias("_all"))
    met = path(pointers.select(group, "place", "to"), group, "place", "to").join(last, F.col(group).eqNullSafe(F.col("_g")))
    d = met.select(group, F.col("place").alias("first"), F.coalesce("to", "_all").alias("end"))
    return placed(d, [group], ["first"], name).select(group, name, "first", "end")


def lines_by_height(items: DataFrame, group: str, y: str, x: str, tolerance: float) -> DataFrame:
    """(group, line, first, end): items from the highest down and from left to right, in lines of those within the
    tolerance of a line's first; places in that order from 0."""
    d = placed(items.select(group, y, x), [group], [F.col(y).desc(), F.col(x)])
    d = d.select(group, "place", (-F.col(y)).alias("_reach"), (F.lit(tolerance) - F.col(y)).alias("_bound"))
    return _cuts(next_beyond(d, group, "place", "_reach", "_bound"), group, "line")


def page_groups(pages: DataFrame, doc: str, page: str, tokens: str, budget: int, overlap: int = 1) -> DataFrame:
    """(doc, page_group, first_page, end_page): groups of pages, each beginning with the last pages of the one before.
    All pages are one group if they fit; else a group closes before it passes the mean of ``budget`` and of an even
    share. Places of the walk: 0 is the start, i + 1 a group that closed before page i."""
    d = pages.select(doc, F.col(page).alias("_page"), F.coalesce(tokens, F.lit(0)).cast("long").alias("_n"))
    d = summed(placed(d, [doc], ["_page"], count="_pages"), [doc], ["place"], "_n", "_before")
    total = d.groupBy(F.col(doc).alias("_d")).agg(F.sum("_n").alias("_all"))
    share = F.ceil((F.col("_all") / F.ceil(F.col("_all") / budget) + budget) / 2)
    d = d.join(total, F.col(doc).eqNullSafe(F.col("_d"))).withColumn("_most", F.when(F.col("_all") <= budget, budget).otherwise(share))
    # The page a group begins with stands ``overlap`` before the one it closed at: its sum so far is that page's.
    start = d.select(F.col(doc).alias("_s"), (F.col("place") + overlap).alias("_at"), F.col("_before").alias("_from"))
    d = d.join(start, F.col(doc).eqNullSafe(F.col("_s")) & (F.col("place") == F.col("_at")), "left")
    reach = F.col("_before") + F.col("_n")
    closed = d.select(doc, (F.col("place") + 1).alias("place"), reach.alias("_reach"), (F.coalesce("_from", F.lit(0)) + F.col("_most")).alias("_bound"), "_pages")
    begun = d.where("place = 0").select(doc, F.lit(0).cast("long").alias("place"), F.lit(-1).cast("long").alias("_reach"), F.col("_most").alias("_bound"), "_pages")
    steps = next_beyond(begun.unionByName(closed), doc, "place", "_reach", "_bound")
    met = path(steps.select(doc, "place", "to", "_pages"), doc, "place", "to")
    g = met.select(doc, F.when(F.col("place") == 0, 0).otherwise(F.greatest(F.col("place") - 1 - overlap, F.lit(0))).cast("long").alias("first_page"), F.coalesce(F.col("to") - 1, F.col("_pages")).cast("long").alias("end_page"), "place")
    return placed(g, [doc], [F.col("place")], "page_group").select(doc, "page_group", "first_page", "end_page")
