"""Each box against all others of its image and label."""

import random

import pytest

from reelquery.operators import nms


def _plain(rows):
    out = {}
    for image, label, a, *p in rows:
        for other, lab, b, *q in rows:
            if (image, label) != (other, lab) or a == b:
                continue
            best, n = out.setdefault((image, a), (None, 0))
            if None not in p and None not in q:
                ix, iy = max(0, min(p[2], q[2]) - max(p[0], q[0])), max(0, min(p[3], q[3]) - max(p[1], q[1]))
                union = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - ix * iy
                v = ix * iy / union if union > 0 else 0.0
                best, n = v if best is None else max(best, v), n + (v > 0.5)
            out[image, a] = best, n
    return out


@pytest.mark.parametrize("most", [100_000, 60])
@pytest.mark.parametrize("spread", [6, 30, 3000])
def test_best_overlaps_against_all_pairs(spark, spread, most):
    rng = random.Random(spread)
    rows = []
    for i in range(420):
        x, y = rng.randrange(spread), rng.randrange(spread) / 2
        rows.append((rng.randrange(2), 0, i // 2 if i % 5 else i, float(x), y, x + rng.choice([0.0, 3.0, 5.0, 7.3]), y + rng.choice([4.0, 5.5])))
    rows += [(0, 0, 900, None, 1.0, 2.0, 3.0), (7, 0, 1, 0.0, 0.0, 1.0, 1.0), (7, 1, 2, 0.0, 0.0, 1.0, 1.0), (8, 0, 1, 0.0, 0.0, 4.0, 1.0), (8, 0, 1, 0.0, 0.0, 4.0, 1.0), (8, 0, 3, 0.0, 0.0, 3.0, 1.0)]
    boxes = spark.createDataFrame(rows, "image_id long, label int, box_id long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.image_id, r.box_id): (r.best, r.n_over) for r in nms.best_overlaps(boxes, most=most).collect()}
    assert got == _plain(rows)
