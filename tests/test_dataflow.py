"""Constants that reach a call, and ways from components, against plain loops."""

import random
from collections import deque

from wiretide.operators import dataflow

CODE = "sample_id int, method string, pc int, op string, registers array<string>, literal string, api_class string, api_method string, label boolean"


def scan(code, joins=False):
    """Arguments of the watched calls of one method, by going through its instructions."""
    held, out = {}, {}
    for pc, op, regs, literal, target, label in code:
        if joins and label:
            held = {}
        if op.startswith("invoke") and target == "w":
            out[pc] = [held.get(r) for r in regs][0 if "static" in op else 1 :]
        elif op.startswith("const"):
            if op.startswith("const-string"):
                held[regs[0]] = literal[1:-1] if literal and len(literal) > 1 and literal[0] == literal[-1] == '"' else literal
            elif op == "const-class":
                held[regs[0]] = literal
            else:
                try:
                    held[regs[0]] = str(int(literal, 0))
                except (TypeError, ValueError):
                    held[regs[0]] = None
        elif regs and not op.startswith(dataflow.READS):
            held.pop(regs[0], None)
    return out


def test_constants_equal_a_scan(spark):
    draw = random.Random(6)
    rows, want = [], {False: {}, True: {}}
    for m in range(60):
        code = []
        for pc in range(draw.randrange(1, 40)):
            op = draw.choice(["const/4", "const/high16", "const-string", "const-class", "move", "invoke-virtual", "invoke-static", "invoke-virtual", "if-eq", "iput-object", "return-void", "add-int"])
            regs = [f"v{draw.randrange(4)}" for _ in range(0 if op == "return-void" else draw.randrange(0, 4) if op.startswith("invoke") else draw.randrange(1, 3))]
            literal = draw.choice({"const/4": ["1", "-0x2", "0x7F", "-0", "007x", None], "const/high16": ["0", "-12"], "const-string": ['"a b"', '""', '"', "x", '"é\n"', None], "const-class": ["La;"]}.get(op, [None]))
            if literal == "007x" or literal is None and op.startswith("const/"):
                pass
            code.append((pc, op, regs, literal, draw.choice(["w", "o"]) if op.startswith("invoke") else None, draw.random() < 0.15))
        rows += [(1, f"m{m}", pc, op, regs, literal, "La;" if t else None, t, label) for pc, op, regs, literal, t, label in code]
        for joins in (False, True):
            want[joins] |= {(f"m{m}", pc): args for pc, args in scan(code, joins).items()}
    df = spark.createDataFrame(rows + rows[:5], CODE)
    watched = spark.createDataFrame([("La;", "w")], "api_class string, api_method string")
    for joins in (False, True):
        got = {(r.method, r.pc): r.arguments for r in dataflow.constant_arguments(df, watched, joins).collect()}
        assert got == want[joins]
    assert dataflow.constant_arguments(df.limit(0), watched).collect() == []


def search(calls, target, homes, nodes, depth):
    """First component met and the way to it, by a queue."""
    callers = {}
    for a, b in sorted(calls):
        callers.setdefault(b, []).append(a)
    queue, seen = deque([[target]]), {target}
    while queue and len(seen) < nodes:
        way = queue.popleft()
        if way[-1] in homes:
            return way[::-1]
        if len(way) > depth:
            continue
        for c in callers.get(way[-1], []):
            if c not in seen:
                seen.add(c)
                queue.append([*way, c])
    return None


def test_ways_equal_a_queue(spark):
    draw = random.Random(3)
    names = [f"n{i:03d}" for i in range(150)]
    calls = {(draw.choice(names), draw.choice(names)) for _ in range(260)}
    homes = set(draw.sample(names, 12))
    c = spark.createDataFrame([(1, a, b) for a, b in calls] + [(2, "x", "y")], "sample_id int, caller string, callee string")
    t = spark.createDataFrame([(1, n) for n in names[:60]] + [(2, "y")], "sample_id int, target string")
    h = spark.createDataFrame([(1, n) for n in homes], "sample_id int, method string")
    for nodes, depth in ((4000, 8), (9, 8), (4000, 2)):
        got = {(r.sample_id, r.target): r.way for r in dataflow.ways(c, t, h, nodes, depth).collect()}
        want = {(1, n): search(calls, n, homes, nodes, depth) for n in names[:60]}
        assert got == {k: w for k, w in want.items() if w}
        assert len(got) > 3
