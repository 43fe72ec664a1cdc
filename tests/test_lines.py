"""Changed lines against a table of common subsequences, and pairs of conditions against plain search."""

import random

import numpy as np

from tracequarry.operators import lines


def common(x, y):
    """Length of a longest common subsequence, by the whole table."""
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_pairs_are_longest():
    rng = random.Random(3)
    for _ in range(300):
        x, y = ([rng.randrange(rng.choice([2, 4, 30])) for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = sorted(lines.common_pairs(np.array(x), np.array(y)))
        assert len(pairs) == common(x, y) and all(x[a] == y[b] for a, b in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        values = rng.sample(range(50), rng.randrange(20))
        rise = [values[i] for i in lines.longest_rising(values)]
        assert rise == sorted(rise) and len(rise) == common(values, sorted(values))


def files():
    rng = random.Random(9)
    out = [("same", "a\nb", "a\nb"), ("null", None, "x\ny\n"), ("both", None, ""), ("end", "a\nb\n", "a\nb"), ("odd", "a\r\nb\rc\x0bd e", "a\nb\nd\ne\n"), ("swap", "1\n2\n3\n4", "3\n4\n1\n2"), ("blank", "\n\n\n", "\n\n"), ("one", "x", "y")]
    for k in range(40):
        few = [f"line {rng.randrange(rng.choice([3, 8, 60]))}" for _ in range(rng.randrange(40))]
        new = [x for x in few if rng.random() < 0.8]
        for _ in range(rng.randrange(6)):
            new.insert(rng.randrange(len(new) + 1), rng.choice(["line 1", "fresh"]))
        if k % 4 == 0 and len(new) > 6:
            new = new[5:] + new[:5]
        out.append((f"f{k}", "\n".join(few), "\n".join(new)))
    out.append(("repeated", "\n".join("ab"[i % 3 % 2] for i in range(300)), "\n".join("ab"[i % 5 % 2] for i in range(280))))
    return out


def test_line_changes(spark):
    table = files()
    old, new = (spark.createDataFrame([(f[0], f[s]) for f in table], "path string, text string") for s in (1, 2))
    got = {}
    for r in lines.line_changes(old, new).collect():
        got.setdefault(r.path, {"-": {}, "+": {}})[r.change][r.pos] = r.line
    # a text with other ends of its lines is opened, and loses nothing
    for path, a, b in table:
        x, y = (a or "").splitlines(), (b or "").splitlines()
        found = got.pop(path, {"-": {}, "+": {}})
        assert all(x[p] == v for p, v in found["-"].items()) and all(y[p] == v for p, v in found["+"].items())
        stay = [v for p, v in enumerate(x) if p not in found["-"]]
        assert stay == [v for p, v in enumerate(y) if p not in found["+"]], path
        unique = [v for v in x if x.count(v) == 1 and y.count(v) == 1]
        if not unique or [v for v in y if v in unique] == unique:  # anchors do not cross: as much stays as can
            assert len(stay) >= len(unique) and (unique or len(stay) == common(x, y)), path
    assert not got
    assert lines.line_changes(old.limit(0), new).count() == 0


def test_moved_block_and_first_lines(spark):
    old, new = spark.createDataFrame([("p", "a\nb\nc\nd\ne")], "path string, text string"), spark.createDataFrame([("p", "d\nx\na\nb\nc\ne")], "path string, text string")
    changes = lines.line_changes(old, new)
    assert sorted(map(tuple, changes.collect())) == [("p", "+", 0, "d"), ("p", "+", 1, "x"), ("p", "-", 3, "d")]
    assert [tuple(r) for r in lines.first_changes(changes, first=1).collect()] == [("p", 1, 2, ["d"], ["d"])]


def plainly(removed, added):
    """The search as it is told: each removed condition takes the first line not used yet."""
    used, out = set(), []
    for r in removed:
        for line in dict.fromkeys(a[0] for a in added):
            if line in used:
                continue
            first = next((a for a in added if a[0] == line and a[1] == r[1]), None)
            if first is not None and first[2] != r[2]:
                used.add(line)
                out.append((r, first))
                break
    return out


def test_first_unused():
    rng = random.Random(4)
    for _ in range(400):
        removed, added = ([(rng.randrange(9), rng.choice("xyz"), rng.randrange(3)) for _ in range(rng.randrange(12))] for _ in range(2))
        removed, added = sorted(removed, key=lambda c: c[0]), sorted(added, key=lambda c: c[0])
        assert [(removed[i], added[j]) for i, j in lines.first_unused(removed, added)] == plainly(removed, added)


def test_unused_pairs(spark):
    shape = "file string, line int, place int, lhs string, operator string, number double"
    removed = spark.createDataFrame([("f", 1, 0, "Age", ">", 5.0), ("f", 2, 0, "age", ">", 6.0), ("f", 3, 0, "sum", "<", 1.0), ("g", 1, 0, "age", ">", 5.0), (None, 1, 0, "age", ">", 5.0)], shape)
    added = spark.createDataFrame([("f", 1, 0, "AGE", ">", 5.0), ("f", 2, 0, "age", ">", 7.0), ("f", 2, 1, "sum", "<", 2.0), ("h", 1, 0, "age", ">", 9.0), ("f", 9, 0, None, ">", 1.0)], shape)
    got = sorted(map(tuple, lines.unused_pairs(removed, added).collect()))
    # the equal condition on line 1 is not used up by the first; line 2 is, for all its left sides
    assert got == [("f", "age", 1, ">", 5.0, 2, ">", 7.0), ("f", "age", 2, ">", 6.0, 1, ">", 5.0)]
