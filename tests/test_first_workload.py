"""Frames to peaks by centres of mass, all steps together, against plain loops."""

import numpy as np

from diffspark.plans import workloads
from diffspark.sources import io

SIDE, SIZE = 80, 20
PARAMS = {"width": SIDE, "height": SIDE, "ybc": 40.25, "zbc": 39.75, "px": 200.0, "lsd": 1e6, "tx": 0.0, "ty": 0.0, "tz": 0.0, "rho": 20000.0, "ring_width": 4000.0, "p": [0.0] * 15}


def frames():
    rng, out = np.random.default_rng(12), {}
    for f in range(2, 5):
        x = np.zeros((SIDE, SIDE))
        for _ in range(6):
            z, y = rng.integers(12, 66, 2)
            for r in range(-4, 5):
                for c in range(-4, 5):
                    x[z + r, y + c] += np.round(900 * np.exp(-(r * r + 1.3 * c * c) / rng.uniform(3, 6)))
        out[f] = x
    return out


def peaks_by_loops(x):
    """z00, y00, centre, sum, pixels of every peak of a frame, in the order of numbering."""
    radius = np.hypot(np.arange(SIDE) - 40.25, (np.arange(SIDE) - 39.75)[:, None])
    good = np.where((np.abs(radius - 25) <= 20) & (x >= 5), x, 0)
    left, out, no = {(r, c) for r, c in zip(*np.nonzero(good), strict=True)}, [], 0
    for start in sorted(left):
        if start not in left:
            continue
        spot, todo = set(), [start]
        while todo:
            p = todo.pop()
            if p in left:
                left.remove(p)
                spot.add(p)
                todo += [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        no += 1
        z, y = min(spot, key=lambda p: (-good[p], p))
        z00, y00 = z - 10, y - 10
        if len(spot) < 2 or not (0 <= z00 < SIDE - SIZE and 0 <= y00 < SIDE - SIZE):
            continue
        px = np.zeros((SIZE, SIZE))
        for r, c in spot:
            if 0 <= r - z00 < SIZE and 0 <= c - y00 < SIZE:
                px[r - z00, c - y00] = good[r, c]
        found = []
        for r in range(2, 18):
            for c in range(2, 18):
                if px[r, c] > 0.2 * px.max() and px[r, c] == px[r - 2 : r + 3, c - 2 : c + 3].max():
                    found.append((-px[r, c], r, c))
        n_peaks = len(found)
        found = [(r, c) for _, r, c in sorted(found) if 2.5 <= r <= 17.5 and 2.5 <= c <= 17.5]
        label, waiting = np.zeros((SIZE, SIZE), int), []
        for k, p in enumerate(found):
            label[p] = k + 1
        waiting = [(-px[p], k, p) for k, p in enumerate(sorted(found))]
        age, mask = len(waiting), px > 0.2 * px.max()
        while waiting:
            waiting.sort()
            _, _, (r, c) = waiting.pop(0)
            for i, j in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
                if 0 <= i < SIZE and 0 <= j < SIZE and mask[i, j] and not label[i, j]:
                    label[i, j] = label[r, c]
                    waiting.append((-px[i, j], age, (i, j)))
                    age += 1
        for k, (r, c) in enumerate(found):
            box = px[r - 1 : r + 1, c - 1 : c + 1]
            w = np.where(box < 0.7 * box.max(), 0, box)
            row, col = r - 1 + w.sum(1) @ [0, 1] / w.sum(), c - 1 + w.sum(0) @ [0, 1] / w.sum()
            own = px[label == k + 1]
            out.append(((z00, y00, no, k + 1), z00 + row, y00 + col, own.sum(), (own > 0.01).sum(), own.max(), n_peaks, px.sum(), len(spot)))
    return [row[1:] for row in sorted(out)]


def test_frames_to_peaks(spark, tmp_path):
    stack = frames()
    rows = [("s", f, int(r), int(c), float(x[r, c])) for f, x in stack.items() for r, c in zip(*np.nonzero(x), strict=True)]
    pixels = spark.createDataFrame(rows, "scan_id string, frame_id long, z int, y int, intensity double").repartition(5)
    labelled = workloads.frames_to_spots(pixels, PARAMS, [25.0], [5.0], skip=2)
    listed = spark.createDataFrame([(3, 77.0)], "frame_idx long, omega double")
    got = workloads.frames_to_peaks(labelled, PARAMS, skip=2, omega_start=-180.0, omega_step=0.25, listed_omega=listed)
    table = got.orderBy("frame_id", "spot_id").collect()
    assert set(io.SNAKE) <= set(got.columns)
    at = 0
    for f, x in stack.items():
        for k, (z, y, total, n, top, n_peaks, isum, pixels_) in enumerate(peaks_by_loops(x)):
            r = table[at]
            assert (r.frame_id, r.spot_id, r.omega) == (f - 2, k + 1, 77.0 if f == 3 else -180 + 0.25 * f)
            assert np.allclose([r.zcen, r.ycen, r.integrated_intensity, r.nr_pixels, r.imax, r.n_peaks, r.raw_sum_intensity, r.total_nr_pixels], [z, y, total, n, top, n_peaks, isum, pixels_])
            assert np.isclose(r.radius, np.hypot(y - 40.25, z - 39.75)) and np.isclose(r.diff_y, r.max_y - y)
            at += 1
    assert at == len(table) > 8
