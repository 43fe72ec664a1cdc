"""json_structural_compare against a comparison of whole turns."""

import json

from tracequarry.plans import catalogue

TURNS = [
    ("a", 1, "user", "one two three four"), ("a", 2, "user", "one two threX four"), ("a", 3, "user", "one two threX four"),
    ("a", 4, "bot", "one two"), ("a", 5, "bot", "one two three"), ("b", 1, "user", "alone"), ("b", 2, "user", ""), ("b", 3, None, "  alone"),
]


def brute(before, after, path=""):
    if type(before) is not type(after):
        yield path, "VALUE_MISMATCH" if None in (before, after) else "TYPE_MISMATCH"
    elif isinstance(before, (dict, list)):
        both = (before, after) if isinstance(before, dict) else [dict(enumerate(x)) for x in (before, after)]
        if isinstance(before, list) and len(before) != len(after):
            yield path, "LIST_LENGTH_MISMATCH"
        for k in {**both[0], **both[1]}:
            own = f"{path}[{k}]" if isinstance(before, list) else f"{path}.{k}" if path else k
            if k not in both[1] or k not in both[0]:
                yield own, "MISSING_IN_ACTUAL" if k in both[0] else "UNEXPECTED_IN_ACTUAL"
            else:
                yield from brute(both[0][k], both[1][k], own)
    elif before != after:
        yield path, "VALUE_MISMATCH"


def test_whole_turns_are_compared(spark, tmp_path):
    spark.createDataFrame(TURNS, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["pair_id"], r["path"], r["issue"]) for r in catalogue.queries()["json_structural_compare"](spark, str(tmp_path)).collect()}
    body = lambda role, text: ({"role": role} if role else {}) | {"said": {"chars": len(text), "words": text.split(" ")}}
    pairs = [(f"{c}/{n}", body(*x), body(*y)) for (d, _, *x), (c, n, *y) in zip(TURNS, TURNS[1:]) if c == d]
    assert got == {(k, p, i) for k, x, y in pairs for p, i in brute(json.loads(json.dumps(x)), y)}
    assert ("a/2", "said.words[2]", "VALUE_MISMATCH") in got
