"""Event groups hold every copy of a title, and no link between different titles is lost to a representative's time."""

import random
from datetime import datetime, timedelta

from chronofact.operators import grouping as gr

#: The start of a bucket of 48 hours.
T0 = datetime(1970, 1, 1) + timedelta(hours=48 * 9000)


def test_copies_join_their_group(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    rows = [(i, "alpha beta gamma delta", i) for i in range(1, 30)] + [(40, "alpha beta gamma delta epsilon", 5), (50, "other words here now", 3), (51, "other words here now", 9), (60, None, 1), (61, None, 1), (70, "alone in this", 7)]
    # Of (80, 81) only the copy is within 48 hours of the other title in the next bucket.
    rows += [(80, "one two three four", 0), (81, "one two three four", 47), (82, "one two three four five", 60), (90, "one two three four six", 47 + 96)]
    items = spark.createDataFrame([(i, t, T0 + timedelta(hours=h)) for i, t, h in rows], "id int, title string, published_at timestamp")
    pairs = gr.similar_titles(items).union(gr.title_copies(items))
    assert (80, 82) in {(r["a"], r["b"]) for r in gr.similar_titles(items).collect()}
    got = {r["id"]: r["event_id"] for r in gr.event_groups(items.select("id"), pairs).collect()}
    assert got == {**{i: 1 for i in range(1, 30)}, 40: 1, 50: 50, 51: 50, 60: 60, 61: 61, 70: 70, 80: 80, 81: 80, 82: 80, 90: 90}


def test_labels_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Labels are as many as items, so no round may build them on the driver."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path}")
    plans, checkpoint = [], type(spark.range(1)).checkpoint

    def noted(df, *args):
        out = checkpoint(df, *args)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", noted)
    items, pairs = spark.range(200), spark.range(100).selectExpr("id as a", "id + 100 as b")
    got = gr.event_groups(items, pairs).collect()
    assert {r["id"]: r["event_id"] for r in got} == {i: i % 100 for i in range(200)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_similar_titles_join_hashes_and_lose_no_pair(spark, monkeypatch):
    """No join carries words, and the pairs are those of plain loops over classes."""
    rng = random.Random(4)
    rows = [(i, " ".join(dict.fromkeys(rng.choices("abcdefghi", k=rng.randint(1, 6)))), rng.randint(0, 47 * 4)) for i in range(150)]
    joined, join = [], type(spark.range(1)).join

    def noted(df, other, *args):
        joined.append({kind for side in (df, other) for _, kind in side.dtypes})
        return join(df, other, *args)

    monkeypatch.setattr(type(spark.range(1)), "join", noted)
    items = spark.createDataFrame([(i, t, T0 + timedelta(hours=h)) for i, t, h in rows], "id int, title string, published_at timestamp")
    got = sorted(map(tuple, gr.similar_titles(items).collect()))
    classes = {}
    for i, t, h in rows:
        classes.setdefault((tuple(t.split()), h // 48), []).append((i, h))
    known = [(min(i for i, _ in m), set(w), t, min(h for _, h in m), max(h for _, h in m)) for (w, t), m in classes.items()]
    want = []
    for a, wa, ta, fa, la in known:
        for b, wb, tb, fb, lb in known:
            if a < b and abs(ta - tb) <= 1 and (ta == tb or max(fb - la, fa - lb) <= 48) and len(wa & wb) / len(wa | wb) >= 0.6:
                want.append((a, b))
    assert got == sorted(want) and len(got) > 50
    assert len(joined) == 2 and not any("string" in kind for kinds in joined for kind in kinds)
