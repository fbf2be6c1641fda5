"""Undo and redo against two plain stacks, batch and stream alike; range joins and differences against plain loops."""

import random

from lakeveil.operators import history, intervals


def log(seed, keys=5, count=300):
    rng, at = random.Random(seed), 0
    out = []
    for _ in range(count):
        at += rng.choice([1, 1, 3])
        out.append((rng.choice([*range(keys), 0, 0, None]), at, rng.choice(["do", "do", "undo", "undo", "redo", "noise", None]), rng.choice(["a", "b", "c", None]), "x"))
    return out


def plain(events):
    out = {}
    for key, _, action, value, _ in sorted(events, key=lambda e: e[1]):
        if key is not None:
            done, undone = out.setdefault(key, ([], []))
            if action == "do":
                done.append(value)
                undone.clear()
            elif action == "undo" and done:
                undone.append(done.pop())
            elif action == "redo" and undone:
                done.append(undone.pop())
    return out


SCHEMA = "doc_id long, seq long, action string, value string, key string"


def test_log_is_folded_in_order(spark):
    for seed in range(3):
        events = log(seed)
        df = spark.createDataFrame(random.Random(9).sample(events, len(events)), SCHEMA).repartition(5)
        assert {r.doc_id: (r.done, r.undone) for r in history.standing(df).collect()} == plain(events)
    assert history.standing(df.limit(0)).count() == 0
    hot = [(1, i, "do" if i % 3 else "undo", str(i), "") for i in range(25_000)]  # over several Arrow batches
    assert {r.doc_id: (r.done, r.undone) for r in history.standing(spark.createDataFrame(hot, SCHEMA)).collect()} == plain(hot)


def test_stream_and_batch_agree(spark, tmp_path):
    events = log(4, count=120)
    for i in range(3):
        spark.createDataFrame(events[40 * i : 40 * i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = history.standing_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
        last = {}

        def take(batch, _):
            last.update({r.doc_id: (r.done, r.undone) for r in batch.collect()})

        query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").foreachBatch(take).trigger(availableNow=True).start()
        query.awaitTermination()
        want = plain(events[: 40 * i + 40])
        assert last and all(want[k] == v for k, v in last.items())
    assert set(last) <= set(want)


def spans(rng, count, most=300):
    out = []
    for _ in range(count):
        a = rng.randrange(most)
        out.append((rng.choice([1, 1, 1, 2, None]), a, a + rng.choice([0, 1, 3, 9, 70]), rng.choice(["A", "B"]), rng.random()))
    return out


FIELDS = "doc_id long, start int, end int, entity_type string, n double"


def test_range_join_gives_each_pair_once(spark):
    rng = random.Random(1)
    a, b = spans(rng, 80), spans(rng, 90)
    a.append(a[0])
    for width in (7, 1024):
        got = intervals.interval_join(spark.createDataFrame(a, FIELDS), spark.createDataFrame(b, FIELDS), ["doc_id"], width=width).collect()
        want = [(*x, *y[1:]) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def plain_difference(a, b):
    a, b = sorted(x[:4] for x in a), sorted(x[:4] for x in b)
    out = []

    def take(name, keys):
        for x in list(a):
            fits = [y for y in b if keys(x) == keys(y)]
            if fits:
                out.append((name, x, fits[0]))
                a.remove(x)
                b.remove(fits[0])

    take("same", lambda x: x)
    take("retyped", lambda x: x[:3])
    touch = lambda x, y: x[0] == y[0] and x[3] == y[3] and max(x[1], y[1]) < min(x[2], y[2])
    ai, bi = list(enumerate(a)), list(enumerate(b))
    first_b = {i: next((j for j, y in bi if touch(x, y)), None) for i, x in ai}
    first_a = {j: next((i for i, x in ai if touch(x, y)), None) for j, y in bi}
    pairs = {(i, j) for i, j in first_b.items() if j is not None and first_a[j] == i}
    out += [("moved", a[i], b[j]) for i, j in pairs]
    out += [("lost", x, None) for i, x in ai if i not in {p[0] for p in pairs}] + [("new", None, y) for j, y in bi if j not in {p[1] for p in pairs}]
    return sorted(map(str, out))


def test_difference_uses_each_finding_once(spark):
    for seed in (2, 3):
        rng = random.Random(seed)
        a = [x for x in spans(rng, 60, 120) if x[0] is not None and x[1] < x[2]]
        b = [(x[0], x[1] + rng.choice([0, 0, 1]), x[2] + rng.choice([0, 0, 2]), rng.choice([x[3], x[3], "C"]), 0.0) for x in a if rng.random() < 0.8] + [x for x in spans(rng, 20, 120) if x[0] is not None and x[1] < x[2]]
        a, b = a + a[:3], b + b[:1]
        got = intervals.run_difference(spark.createDataFrame(a, FIELDS), spark.createDataFrame(b, FIELDS), width=16)
        rows = []
        for r in got.collect():
            x = None if r.start is None else (r.doc_id, r.start, r.end, r.entity_type)
            y = None if r.after_start is None else (r.doc_id, r.after_start, r.after_end, r.after_type)
            rows.append(str((r.change, x, y)))
        assert sorted(rows) == plain_difference(a, b)
    counts = intervals.difference_counts(got).collect()
    assert sum(r.same + r.retyped + r.moved + r.lost for r in counts) == len(a)
    empty = spark.createDataFrame([], FIELDS)
    assert intervals.run_difference(empty, empty).count() == 0
