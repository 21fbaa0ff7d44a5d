"""The chunked tracker against a plain loop over whole videos."""

import numpy as np
import pytest

from reelquery.operators import tracks


def plain_tracks(regions, least):
    """Tracks of each video: members and mean of each, in order of their first member; all tokens in memory."""
    out = {}
    for video in {r[0] for r in regions}:
        frames, made = {}, []
        for _, f, j, tok in sorted((r for r in regions if r[0] == video), key=lambda r: r[1:3]):
            frames.setdefault(f, []).append(np.array(tok, float))
        for f, tokens in sorted(frames.items()):
            open_ = [t for t in made if t["members"][-1][0] == f - 1]
            unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
            pairs = sorted(((-float(unit(t["mean"]) @ unit(x)), i, j) for i, t in enumerate(open_) for j, x in enumerate(tokens)), key=lambda p: p[0])
            used, given = set(), {}
            for s, i, j in pairs:
                if -s >= least and i not in used and j not in given:
                    used.add(i)
                    given[j] = open_[i]
            for j, x in enumerate(tokens):
                if j in given:
                    t = given[j]
                    t["members"].append((f, j))
                    t["mean"] = t["mean"] + (x - t["mean"]) / len(t["members"])
            made += [{"mean": x, "members": [(f, j)]} for j, x in enumerate(tokens) if j not in given]
        out[video] = made
    return out


def some(seed, videos=4, n=30, width=6):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, width))
    rows = []
    for v in range(videos):
        for f in range(n):
            if f % 11 == 7 or (v == 2 and f % 2):
                continue  # gaps end all tracks
            shown = rng.permutation(5)[: rng.integers(1, 6)]
            rows += [(v, f, j, (base[k] + 0.3 * rng.normal(size=width)).tolist()) for j, k in enumerate(shown)]
    return rows


@pytest.mark.parametrize("batch", [1, 3, 7, 10000])
def test_tracks_are_the_same_for_any_chunk(spark, batch):
    rows = some(5)
    want = plain_tracks(rows, 0.65)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = tracks.track(spark.createDataFrame(rows, "video_id int, frame_idx int, region_idx int, tok array<double>").repartition(3)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == sum(map(len, want.values()))
    for r in got:
        one = want[r.video_id][r.track_id]
        assert [(m.frame_idx, m.region_idx) for m in r.members] == one["members"]
        assert np.abs(np.array(r.tok) - one["mean"]).max() < 1e-12


def test_registered_tracker_matches_the_plain_loop(spark):
    from reelquery import catalog

    sf = "/root/testdata/sf0.001"
    rows = [(r.video_id, r.frame_idx, r.region_idx, r.tok) for r in catalog._regions(spark, sf).collect()]
    want = plain_tracks(rows, 0.65)
    got = sorted((r.video_id, r.track_id, r.n_members, r.norm) for r in catalog.queries()["region_tracker"](spark, sf).collect())
    flat = sorted((v, k, len(t["members"]), float(np.linalg.norm(t["mean"]))) for v, found in want.items() for k, t in enumerate(found))
    assert [g[:3] for g in got] == [w[:3] for w in flat] and max(abs(g[3] - w[3]) for g, w in zip(got, flat, strict=True)) < 1e-5
    ratio = {r.video_id: (r.n_tracks, r.n_members) for r in catalog.queries()["track_compression"](spark, sf).collect()}
    assert ratio == {v: (len(found), sum(len(t["members"]) for t in found)) for v, found in want.items()}


def test_open_tracks_are_all_that_is_kept():
    linker = tracks.Linker()
    for f in range(500):
        ids, _ = linker.step(f, np.eye(4)[:, :3] if f % 50 else np.eye(4)[:, 1:])
        assert len(linker.ids) == 4 == len(ids) and len(linker.mean) == 4


def test_empty_table(spark):
    none = spark.createDataFrame([], "video_id string, frame_idx int, region_idx int, tok array<double>")
    assert tracks.track(none).collect() == []
