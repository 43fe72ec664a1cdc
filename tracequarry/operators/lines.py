"""Changed lines of files between two versions, and removed conditions paired with added ones."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.store import scratch, stored

#: What ends a line.
BREAKS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence of distinct values."""
    tops: list[int] = []  # of runs of each length the least last value
    place: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            place.append(i)
        else:
            tops[k], place[k] = v, i
        before[i] = place[k - 1] if k else -1
    out, at = [], place[-1] if place else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def common_pairs(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two arrays of numbers, in memory for two rows: halves of x meet the best cut of y."""

    def row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        last = np.zeros(len(b) + 1, np.int64)
        for value in a:
            now = last.copy()
            np.maximum(now[1:], last[:-1] + (b == value), out=now[1:])
            last = np.maximum.accumulate(now)
        return last

    out: list[tuple[int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            same = np.flatnonzero(y[c:d] == x[a])
            out += [(a, c + int(same[0]))] if len(same) else []
            continue
        half = (a + b) // 2
        cut = c + int(np.argmax(row(x[a:half], y[c:d]) + row(x[half:b][::-1], y[c:d][::-1])[::-1]))
        todo += [(a, half, c, cut), (half, b, cut, d)]
    return out


def _split(df: DataFrame, key: str, text: str, side: str) -> DataFrame:
    pieces = F.split(text, BREAKS)
    kept = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return df.select(key, F.lit(side).alias("side"), F.posexplode(kept).alias("pos", "line"))


def line_changes(old: DataFrame, new: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, change, pos, line): lines that a changed file lost ('-', pos in the old text) or got ('+', pos in the new text), from 0.

    Both frames: (key, text), one row for each key; only keys of both whose texts differ in SHA-256 are opened; a null text is empty. Lines that
    are unique on both sides of a stretch and rise on both are anchors (a longest rising choice of them); they split it into stretches that are
    searched for anchors in turn, all files together, round by round. Stretches without anchors are compared in whole, each in a task by itself,
    by a longest common subsequence in memory for its lines only. So what stays is common to both texts in order, and nothing is capped.
    The lines of one file meet in one task, as they do in the file."""
    side = lambda df, name: df.select(key, F.coalesce(text, F.lit("")).alias(name))
    with scratch(old.sparkSession):
        pairs = stored(side(old, "_old").join(side(new, "_new"), key).where(F.sha2("_old", 256) != F.sha2("_new", 256)), "diff-pairs")
        lines = stored(_split(pairs, key, "_old", "-").unionByName(_split(pairs, key, "_new", "+")).withColumn("part", F.lit(0).cast("long")), "diff-lines")
        kind = lines.schema[key].dataType.simpleString()
        matched = None
        while True:
            once = lines.groupBy(key, "part", "line").agg(F.count_if(F.col("side") == "-").alias("a"), F.count_if(F.col("side") == "+").alias("b"), F.max(F.when(F.col("side") == "-", F.col("pos"))).alias("i"), F.max(F.when(F.col("side") == "+", F.col("pos"))).alias("j"))
            anchors = once.where("a = 1 and b = 1").select(key, "part", "i", "j")

            def rising(table: pa.Table) -> pa.Table:
                ordered = table.sort_by("i")
                return ordered.take(pa.array(longest_rising(ordered.column("j").to_pylist()), pa.int64()))

            found = stored(anchors.groupBy(key, "part").applyInArrow(rising, f"{key} {kind}, part long, i int, j int"), "diff-anchors", keep=True)
            if found.isEmpty():
                break
            matched = found if matched is None else matched.unionByName(found)
            # the stretches between anchors: count the anchors up to each line on its own side
            marks = found.select(key, F.lit("-").alias("side"), F.col("i").alias("pos")).unionByName(found.select(key, F.lit("+").alias("side"), F.col("j").alias("pos"))).withColumn("_m", F.lit(1))
            upto = F.sum(F.coalesce("_m", F.lit(0))).over(Window.partitionBy(key, "side").orderBy("pos"))
            placed = lines.join(marks, [key, "side", "pos"], "left").withColumn("_k", upto).where("_m is null")
            # earlier stretches keep their order, so a stretch is told by both numbers
            lines = stored(placed.select(key, "side", "pos", "line", (F.col("part") * (1 << 32) + F.col("_k")).alias("_p")), "diff-lines")
            numbers = lines.select(key, "_p").distinct().withColumn("part", F.dense_rank().over(Window.partitionBy(key).orderBy("_p")).cast("long"))
            lines = stored(lines.join(numbers, [key, "_p"]).select(key, "side", "pos", "line", "part"), "diff-lines")

        both = lines.groupBy(key, "part").agg(F.count_if(F.col("side") == "-").alias("a"), F.count_if(F.col("side") == "+").alias("b")).where("a > 0 and b > 0").select(key, "part")
        shared = lines.groupBy(key, "part", "line").agg(F.countDistinct("side").alias("n")).where("n = 2").select(key, "part", "line")
        rest = lines.join(both, [key, "part"], "left_semi").join(shared, [key, "part", "line"], "left_semi")

        def common(table: pa.Table) -> pa.Table:
            ordered = table.sort_by("pos")
            codes = ordered.column("line").combine_chunks().dictionary_encode().indices.to_numpy()
            is_old = np.array(ordered.column("side").to_pylist()) == "-"
            pos = ordered.column("pos").to_numpy()
            found = common_pairs(codes[is_old], codes[~is_old])
            i, j = pos[is_old][[a for a, _ in found]], pos[~is_old][[b for _, b in found]]
            return pa.table([table.column(key).take(pa.array(np.zeros(len(found), np.int64))), pa.array(np.zeros(len(found), np.int64)), pa.array(i, pa.int32()), pa.array(j, pa.int32())], [key, "part", "i", "j"])

        same = rest.groupBy(key, "part").applyInArrow(common, f"{key} {kind}, part long, i int, j int")
        kept = stored(same if matched is None else matched.unionByName(same), "diff-kept", keep=True)
        every = stored(_split(pairs, key, "_old", "-").unionByName(_split(pairs, key, "_new", "+")), "diff-every", keep=True)
    gone = kept.select(key, F.lit("-").alias("side"), F.col("i").alias("pos")).unionByName(kept.select(key, F.lit("+").alias("side"), F.col("j").alias("pos")))
    return every.join(gone, [key, "side", "pos"], "left_anti").select(key, F.col("side").alias("change"), "pos", "line")


def first_changes(changes: DataFrame, key: str = "path", first: int = 100) -> DataFrame:
    """(key, n_removed, n_added, removed_lines, added_lines): counts of all changed lines, and the first so many of each side in order."""
    ranked = changes.withColumn("_r", F.row_number().over(Window.partitionBy(key, "change").orderBy("pos")))
    listed = lambda s: F.transform(F.array_sort(F.collect_list(F.when((F.col("change") == s) & (F.col("_r") <= first), F.struct("pos", "line")))), lambda x: x["line"])
    return ranked.groupBy(key).agg(F.count_if(F.col("change") == "-").alias("n_removed"), F.count_if(F.col("change") == "+").alias("n_added"), listed("-").alias("removed_lines"), listed("+").alias("added_lines"))


def first_unused(removed: list[tuple], added: list[tuple]) -> list[tuple[int, int]]:
    """For each removed condition, in order, the first added line not used yet that has a condition of its left side with another value.

    Both: (line, left side, value) in order. Of several conditions of a line with one left side the first counts. A line is used up for all its left sides.
    For each left side the added lines stand in heaps by value, so that lines of the removed value are passed over at once."""
    of_value: dict = defaultdict(lambda: defaultdict(list))
    seen = set()
    for k, (line, left, value) in enumerate(added):
        if (line, left) not in seen:
            seen.add((line, left))
            of_value[left][value].append(k)
    heads = {}
    for left, values in of_value.items():
        for places in values.values():
            places.reverse()  # the first is the last to take
        heads[left] = [(places[-1], n, value) for n, (value, places) in enumerate(values.items())]
        heapq.heapify(heads[left])
    used, out = set(), []
    for r, (_, left, value) in enumerate(removed):
        heap, held = heads.get(left, []), []
        while heap:
            k, n, v = heap[0]
            places = of_value[left][v]
            if added[k][0] in used:  # by another left side, or taken before
                heapq.heappop(heap)
                while places and added[places[-1]][0] in used:
                    places.pop()
                if places:
                    heapq.heappush(heap, (places[-1], n, v))
            elif v == value:
                held.append(heapq.heappop(heap))
            else:
                used.add(added[k][0])
                out.append((r, k))
                break
        for x in held:
            heapq.heappush(heap, x)
    return out


def unused_pairs(removed: DataFrame, added: DataFrame) -> DataFrame:
    """(file, lhs, old_line, old_operator, old_number, new_line, new_operator, new_number): each removed condition with the first added line of its file that is not
    used yet and has a condition of the same left side, case aside, with another operator or number.

    Both: (file, line, place, lhs, operator, number); place orders the conditions of a line. Removed conditions choose in order of line and place, so a pair without
    a change uses up nothing. Nulls in file, line or lhs meet nothing. The conditions of one file meet in one task, as its lines do in the file."""
    columns = ["file", "line", "place", "_l", "operator", "number"]
    side = lambda df: df.where("file is not null and line is not null and lhs is not null").select("file", F.col("line").cast("long"), F.col("place").cast("long"), F.lower("lhs").alias("_l"), "operator", F.col("number").cast("double"))
    kind = removed.schema["file"].dataType.simpleString()
    schema = f"file {kind}, lhs string, old_line long, old_operator string, old_number double, new_line long, new_operator string, new_number double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["file", "lhs", "old_line", "old_operator", "old_number", "new_line", "new_operator", "new_number"]
        order = [("line", "ascending"), ("place", "ascending"), ("operator", "ascending"), ("number", "ascending")]
        old, new = (t.select(columns).sort_by(order) for t in (left, right))
        told = lambda t: list(zip(t.column("line").to_pylist(), t.column("_l").to_pylist(), zip(t.column("operator").to_pylist(), t.column("number").to_pylist(), strict=True), strict=True))
        found = first_unused(told(old), told(new))
        a, b = (pa.array([p[s] for p in found], pa.int64()) for s in (0, 1))
        old, new = old.take(a), new.take(b)
        return pa.table([*(old.column(c) for c in ("file", "_l", "line", "operator", "number")), *(new.column(c) for c in ("line", "operator", "number"))], names)

    return side(removed).groupBy("file").cogroup(side(added).groupBy("file")).applyInArrow(run, schema)
