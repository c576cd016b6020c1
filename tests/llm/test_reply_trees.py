import random

from turnmill.llm.reply_trees import branches, format_branches, reply_nodes, reply_trees


def brute(rows, top):
    """{conv: [(leaf, path, score)]} best first."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == conv}
        has_child = {r[2] for r in own.values()}
        found = []
        for leaf in own:
            if leaf in has_child:
                continue
            path, at, seen = [], leaf, set()
            while at in own and at not in seen:
                seen.add(at)
                path.append(at)
                at = own[at][2]
            if at in seen:
                continue
            found.append((leaf, path[::-1], sum(own[x][5] for x in path)))
        out[conv] = sorted(found, key=lambda f: (-f[2], f[0]))[:top]
    return out


def test_random_trees(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        for n in range(rng.randint(1, 25)):
            rows.append((conv, n, rng.randrange(n) if n and rng.random() < 0.9 else None, rng.choice(["user", "assistant"]), f"t{n}", rng.randint(0, 3)))
    rows += [(50, i, i - 1 if i else None, "user", "deep", 1) for i in range(70)]
    rows += [(60, 0, 1, "user", "a", 1), (60, 1, 0, "user", "b", 1), (60, 2, 1, "user", "c", 1)]  # a cycle and what hangs on it
    rows += [(70, 5, 99, "user", "orphan", 2)]
    nodes = spark.createDataFrame(rows, "conv bigint, node bigint, parent bigint, role string, text string, score bigint")
    want = brute(rows, 3)
    got = {}
    for r in format_branches(nodes, top=3).orderBy("conv_id", "branch").collect():
        got.setdefault(r.conv_id, []).append((r.leaf, r.n_turns, r.score))
    assert got == {c: [(leaf, len(p), s) for leaf, p, s in v] for c, v in want.items() if v}
    paths = {(r.conv, r.leaf): r.path for r in branches(nodes).collect()}
    assert all(paths[c, leaf] == p for c, v in want.items() for leaf, p, _ in v)


def test_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, id string, path string, conv string"
    rows = [
        (1, 0, "user", "hi", "a", "b", "c"), (1, 1, "assistant", "one", "a", "b", "c"), (1, 1, "assistant", "three", "a", "b", "c"),
        (1, 1, "assistant", "three", "a", "b", "c"), (None, 0, "user", "x", "a", "b", "c"), (2, None, "user", "x", "a", "b", "c"),
        (3, 0, None, None, None, None, None), (4, 0, "user", "w " * 200_000, "a", "b", "c"),
    ]
    got = reply_trees(spark.createDataFrame(rows, schema)).orderBy("conv_id", "branch").collect()
    assert [(r.conv_id, r.branch, r.n_turns, r.score) for r in got] == [(1, 1, 2, 5), (1, 2, 2, 3), (3, 1, 1, 0), (4, 1, 1, 0)]
    assert got[0].text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nthree<|im_end|>\n"
    assert got[2].text == "<|im_start|>unknown\n<|im_end|>\n"
    assert reply_trees(spark.createDataFrame([], schema)).count() == 0
    assert reply_nodes(spark.createDataFrame(rows, schema)).count() == 5


def test_a_conversation_over_many_partitions(spark):
    """One conversation holds most rows; numbers and parents equal those of a plain loop, also where runs cross partitions."""
    rng = random.Random(8)
    rows = [(1, t, role, f"t{t} {i}") for t, role in enumerate(r for r in ("user", "assistant", "tool", "user") * 60 for _ in range(1)) for i in range(rng.randint(1, 30))]
    rows += [(c, t, rng.choice(["user", "assistant"]), "x") for c in (0, 2, 3) for t in range(rng.randint(1, 40))]
    for batch in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {(r.conv, r.node): (r.parent, r.role, r.text) for r in reply_nodes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        want = {}
        for conv in (0, 1, 2, 3):
            parent, before = None, None
            for node, (_, _, role, text) in enumerate(sorted(set(r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2], r[3]))):
                if before is not None and role != before:
                    parent = node - 1
                before = role
                want[conv, node] = (parent, role, text)
        assert got == want
