"""Cuts inside joined tracks, one box after the other."""

import math
import random

from trackloom.operators import tracks as T


def in_turn(dets, joined, per_second=8.0, least=1.2):
    """Ids handed out track by track in order of first boxes, then in time."""
    out, tracks = {}, {}
    for f, d, tid, t, x1, _, x2, y2 in sorted(dets):
        if tid >= 0:
            tracks.setdefault(joined.get(tid, tid), []).append((t, (x1 + x2) / 2, y2, max(x2 - x1, 1.0), f, d, tid))
        else:
            out[f, d] = tid, tid
    fresh = max([*(r[2] for r in dets), *joined.values()]) + 1
    for track, rows in tracks.items():
        now = None
        rows.sort()
        for i, (t, x, y, w, f, d, tid) in enumerate(rows):
            if i:
                bt, bx, by, bw = rows[i - 1][:4]
                if t > bt and math.hypot(x - bx, y - by) / ((w + bw) / 2) > max(least, per_second * (t - bt)):
                    now, fresh = fresh, fresh + 1
            out[f, d] = (tid, track) if now is None else (now, now)
    return out


def test_leaps(spark):
    rng = random.Random(4)
    for m in (1, 2):
        dets, at = [], {i: [rng.uniform(0, 500), rng.uniform(0, 300)] for i in range(8)}
        for f in range(40):
            for d, i in enumerate(rng.sample(range(8), 5)):
                at[i] = [at[i][0] + rng.gauss(0, 8), at[i][1] + rng.gauss(0, 8)] if rng.random() > 0.08 else [rng.uniform(0, 500), rng.uniform(0, 300)]
                x, y = at[i]
                w = rng.uniform(30, 60)
                dets.append((f, d, i if rng.random() > 0.05 else -1, f / 5, x - w / 2, y - 40, x + w / 2, y))
        joined = {3: 1, 5: 1, 6: 2}
        df = spark.createDataFrame([(m, *r) for r in dets] + [(9, 0, 0, 4, 0.0, 0.0, 0.0, 1.0, 1.0)], "m long, f long, d long, tid long, t double, x1 double, y1 double, x2 double, y2 double").repartition(3)
        j = spark.createDataFrame([(m, a, b) for a, b in joined.items()], "m long, tid long, track long")
        got = {(r.f, r.d): (r.new_tid, r.track) for r in T.sever_leaps(df, j, "m").where(f"m = {m}").collect()}
        want = in_turn(dets, joined)
        assert got == want and max(t for t, _ in want.values()) > 10
