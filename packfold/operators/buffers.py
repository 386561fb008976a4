"""Greedy buffers over an ordered table of any length.

A buffer takes rows until their lengths reach a limit; the row that crosses it is the last.
Where a buffer starts depends on all rows before it, yet no task has to walk all of them:

1. The table is cut into consecutive shards of bounded size. A shard is summed up as a map from
   the tokens an open buffer still *needs* at its start to what is needed at its end and the
   buffers *done* in between. Different starts soon fall into step, so the map is short.
2. Maps of neighbouring shards are composed, block by block, until those left fit one task.
   Walking through them, and back down the blocks, gives the state at the start of every shard.
3. With its start known, each shard numbers the buffers of its rows on its own.

A table of one shard needs only the last step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packfold.plans.ordinals import join_back
from packfold.session import materialize

# Maps composed by one task, and map entries one task may walk through at the top.
BLOCK = 32
TOP_ENTRIES = 2_000_000

MAP_FIELDS = "upto array<bigint>, need array<bigint>, done array<bigint>, total bigint"


def number_buffers(lengths: DataFrame, group: list[str], limit: int, shards: int) -> DataFrame:
    """``lengths`` (``group``, ``shard``, ``ordinal``, ``_len``, ...) plus ``buffer``."""
    if shards > 1:
        lengths = materialize(lengths, "lengths")
        states, count = _shard_starts(lengths, group, limit)
        lengths = join_back(lengths, states, [*group, "shard"], count)
    else:
        lengths = lengths.withColumns({"_need": F.lit(limit).cast("long"), "_done": F.lit(0).cast("long")})
    kept = [f for f in lengths.schema if f.name not in ("_need", "_done", "shard")]
    schema = T.StructType([*kept, T.StructField("buffer", T.LongType())])
    names = [f.name for f in kept]

    def number(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("ordinal")
        ends = np.cumsum(table["_len"].to_numpy().astype(np.int64))
        need, buffer = table["_need"][0].as_py(), table["_done"][0].as_py()
        buffers = np.empty(len(ends), np.int64)
        start, filled = 0, 0
        while start < len(ends):
            stop = min(int(np.searchsorted(ends, filled + need)) + 1, len(ends))
            buffers[start:stop] = buffer
            start, filled, need, buffer = stop, int(ends[stop - 1]), limit, buffer + 1
        return table.select(names).append_column("buffer", pa.array(buffers))

    return lengths.groupBy(*group, "shard").applyInArrow(number, schema)


def _shard_starts(lengths: DataFrame, group: list[str], limit: int) -> tuple[DataFrame, int]:
    """``group``, ``shard``, ``_need`` and ``_done`` at the start of every shard, and their number."""
    keys = ", ".join(f"`{g}` {lengths.schema[g].dataType.simpleString()}" for g in group)
    lead = f"{keys}, " if keys else ""
    tools = _map_tools(limit)

    maps = lengths.groupBy(*group, "shard").applyInArrow(_summarize(group, tools), f"{lead}at bigint, {MAP_FIELDS}")
    levels = [materialize(maps, "maps")]
    while _entries(levels[-1]) > TOP_ENTRIES and levels[-1].count() > levels[-1].select(*group).distinct().count():
        blocks = levels[-1].withColumn("_block", F.floor(F.col("at") / BLOCK))
        composed = blocks.groupBy(*group, "_block").applyInArrow(_compose(group, tools), f"{lead}at bigint, {MAP_FIELDS}")
        levels.append(materialize(composed, "maps"))

    walk, schema = _walk(group, tools), f"{lead}at bigint, _need bigint, _done bigint"
    start = {"_block": F.lit(0).cast("long"), "_need": F.lit(limit).cast("long"), "_done": F.lit(0).cast("long")}
    states = levels.pop().withColumns(start).groupBy(*group, "_block").applyInArrow(walk, schema)
    for maps in reversed(levels):
        inside = maps.withColumn("_block", F.floor(F.col("at") / BLOCK))
        entered = join_back(inside, states.withColumnRenamed("at", "_block"), [*group, "_block"], None)
        states = entered.groupBy(*group, "_block").applyInArrow(walk, schema)
    states = materialize(states.withColumnRenamed("at", "shard"), "states")
    return states, states.count()


def _entries(maps: DataFrame) -> int:
    return maps.agg(F.sum(F.size("upto") + 1)).first()[0] or 0


def _map_tools(limit: int):
    """(build, look_up, compose) for maps held as (upto, need, done, total).

    An open buffer that needs d tokens is filled at the first entry with ``upto`` >= d; past
    the last entry it takes all ``total`` tokens and stays open.
    """

    def shorten(upto, need, done, total):
        import numpy as np

        last = np.append((need[1:] != need[:-1]) | (done[1:] != done[:-1]), True) if len(upto) else slice(0)
        return upto[last], need[last], done[last], total

    def build(lengths):
        import numpy as np

        ends = np.concatenate([[0], np.cumsum(lengths)])
        rows, total = len(lengths), int(ends[-1])
        # row that starts the buffer after one that starts at each row; itself when none fills up
        after = np.searchsorted(ends[1:], ends + limit) + 1
        fills = after <= rows
        jump = np.where(fills, after, np.arange(rows + 1))
        done = fills.astype(np.int64)
        while True:
            done, further = done + done[jump], jump[jump]
            if np.array_equal(further, jump):
                break
            jump = further
        reach = min(int(np.searchsorted(ends[1:], limit)) + 1, rows)
        upto, first = np.unique(ends[1 : reach + 1], return_index=True)
        upto, first = (upto[1:], first[1:]) if len(upto) and upto[0] == 0 else (upto, first)
        last = jump[first + 1]
        return shorten(upto, limit - (total - ends[last]), done[first + 1] + 1, total)

    def look_up(found, needs):
        import numpy as np

        upto, need, done, total = found
        at = np.searchsorted(upto, needs)
        hit = at < len(upto)
        safe = np.where(hit, at, 0)
        if not len(upto):
            return needs - total, np.zeros(len(needs), np.int64)
        return np.where(hit, need[safe], needs - total), np.where(hit, done[safe], 0)

    def compose(left, right):
        import numpy as np

        need, done = look_up(right, left[1])
        upto, done = left[0], done + left[2]
        if left[3] < limit:
            # buffers still open after the left map go on into the right one
            upto = np.concatenate([upto, right[0] + left[3]])
            need, done = np.concatenate([need, right[1]]), np.concatenate([done, right[2]])
        return shorten(upto, need, done, left[3] + right[3])

    return build, look_up, compose


def _map_row(table, group, at, found):
    import pyarrow as pa

    upto, need, done, total = found
    keys = [table[g].slice(0, 1).combine_chunks() for g in group]
    lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (upto, need, done)]
    values = [*keys, pa.array([at], pa.int64()), *lists, pa.array([total], pa.int64())]
    return pa.Table.from_arrays(values, names=[*group, "at", "upto", "need", "done", "total"])


def _maps_of(table):
    """The maps of a block in order."""
    import numpy as np

    table = table.sort_by("at")
    lists = [[np.asarray(x.values, np.int64) for x in table[c]] for c in ("upto", "need", "done")]
    return table, list(zip(*lists, table["total"].to_pylist()))


def _summarize(group, tools):
    build = tools[0]

    def summarize(table):
        import numpy as np

        table = table.sort_by("ordinal")
        return _map_row(table, group, table["shard"][0].as_py(), build(table["_len"].to_numpy().astype(np.int64)))

    return summarize


def _compose(group, tools):
    compose = tools[2]

    def compose_block(table):
        table, maps = _maps_of(table)
        whole = maps[0]
        for found in maps[1:]:
            whole = compose(whole, found)
        return _map_row(table, group, table["_block"][0].as_py(), whole)

    return compose_block


def _walk(group, tools):
    look_up = tools[1]

    def walk(table):
        import numpy as np
        import pyarrow as pa

        table, maps = _maps_of(table)
        need, done = table["_need"][0].as_py(), table["_done"][0].as_py()
        needs, dones = [], []
        for found in maps:
            needs.append(need)
            dones.append(done)
            after, filled = look_up(found, np.array([need], np.int64))
            need, done = int(after[0]), done + int(filled[0])
        out = table.select([*group, "at"]).append_column("_need", pa.array(needs, pa.int64()))
        return out.append_column("_done", pa.array(dones, pa.int64()))

    return walk
