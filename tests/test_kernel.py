"""Kernel densities against sums over points, contour lines against known shapes."""

import math
import random

import pytest

from tallyloom.operators import contours, kernel_density, mass_lines


def brute(points, width):
    """Density at cell centres of points moved to their cells' centres, bandwidths from the points themselves."""
    n = len(points)

    def bandwidth(values):
        if n < 2:
            return width / 2
        mean = sum(values) / n
        return max(math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) * n ** (-1 / 6), width / 2)

    hx, hy = bandwidth([p[0] for p in points]), bandwidth([p[1] for p in points])
    rx, ry = math.ceil(4 * hx / width), math.ceil(4 * hy / width)
    out = {}
    for x, y in points:
        cx, cy = math.floor(x / width), math.floor(y / width)
        for i in range(-rx, rx + 1):
            for j in range(-ry, ry + 1):
                k = math.exp(-0.5 * ((i * width / hx) ** 2 + (j * width / hy) ** 2)) / (2 * math.pi * hx * hy * n)
                out[cx + i, cy + j] = out.get((cx + i, cy + j), 0) + k
    return out


def test_density_by_brute_force(spark):
    rng = random.Random(5)
    groups = {
        "a": [(rng.gauss(0, 1), rng.gauss(3, 0.5)) for _ in range(80)],
        None: [(rng.random(), -rng.random()) for _ in range(30)],
        "one": [(0.3, 0.7)],
        "same": [(2.0, 2.0)] * 5,
    }
    data = [(h, *p) for h, ps in groups.items() for p in ps]
    data += [("a", None, 1.0), ("a", 1.0, None), ("a", math.nan, 1.0), ("a", 1.0, -math.inf), ("none", None, None)]
    df = spark.createDataFrame(data, "n string, mass double, d double")
    found = {}
    for r in kernel_density(df, "mass", "d", "n", 0.25).collect():
        found.setdefault(r["n"], {})[r["cell_x"], r["cell_y"]] = r["density"]
    assert set(found) == set(groups)
    for h, points in groups.items():
        want = brute(points, 0.25)
        assert found[h].keys() == want.keys()
        assert all(math.isclose(found[h][c], want[c], rel_tol=1e-9) for c in want)


def test_nothing(spark):
    empty = kernel_density(spark.createDataFrame([], "h string, x double, y double"), "x", "y", "h", 0.1)
    assert empty.collect() == [] and mass_lines(empty, "h").collect() == []
    assert contours(empty, mass_lines(empty, "h"), "h", 0.1).collect() == []
    with pytest.raises(ValueError):
        kernel_density(empty, "cell_x", "cell_y", "h", 0.0)


def test_lines_hold_their_mass(spark):
    df = spark.createDataFrame([(None, float(i % 7), float(i % 5)) for i in range(60)], "h string, x double, y double")
    density = kernel_density(df, "x", "y", "h", 0.5).cache()
    values = sorted((r["density"] for r in density.collect()), reverse=True)
    heights = [r["height"] for r in sorted(mass_lines(density, "h").collect(), key=lambda r: r["line"])]
    assert heights[2] == values[0]
    for height, p in zip(heights, (0.05, 0.525)):
        assert sum(v for v in values if v >= height) >= (1 - p) * sum(values) - 1e-9
        assert sum(v for v in values if v > height) < (1 - p) * sum(values)


def grid(spark, values):
    cells = [("g", i, j, float(v)) for j, row in enumerate(values) for i, v in enumerate(row)]
    return spark.createDataFrame(cells, "h string, cell_x bigint, cell_y bigint, density double")


def closed(segments):
    """Every end point is the end of exactly two segments."""
    ends = {}
    for r in segments:
        for p in ((r["x0"], r["y0"]), (r["x1"], r["y1"])):
            key = (round(p[0], 9), round(p[1], 9))
            ends[key] = ends.get(key, 0) + 1
    return all(n == 2 for n in ends.values())


def test_contours_of_known_grids(spark):
    lines = spark.createDataFrame([("g", 0, 0.5)], "h string, line int, height double")
    one = contours(grid(spark, [[1]]), lines, "h", 2.0).collect()
    assert len(one) == 4 and closed(one)
    assert {(r["x0"], r["y0"]) for r in one} | {(r["x1"], r["y1"]) for r in one} == {(1, 0), (1, 2), (0, 1), (2, 1)}
    # Two corners across a square: apart where the mean is below the height, in one piece else.
    apart = contours(grid(spark, [[0.6, 0], [0, 0.6]]), lines, "h", 1.0).collect()
    whole = contours(grid(spark, [[2, 0], [0, 2]]), lines, "h", 1.0).collect()
    assert len(apart) == 8 and closed(apart) and len(whole) == 8 and closed(whole)


def test_contours_are_closed_and_lie_on_the_line(spark):
    rng = random.Random(3)
    values = [[rng.random() for _ in range(9)] for _ in range(8)]
    lines = spark.createDataFrame([("g", i, h) for i, h in enumerate((0.2, 0.5, 0.8))], "h string, line int, height double")
    found = contours(grid(spark, values), lines, "h", 1.0).collect()

    def at(x, y):
        i, j = math.floor(x - 0.5 + 1e-9), math.floor(y - 0.5 + 1e-9)
        v = lambda a, b: values[b][a] if 0 <= a < 9 and 0 <= b < 8 else 0.0
        s, t = x - 0.5 - i, y - 0.5 - j
        return v(i, j) * (1 - s) * (1 - t) + v(i + 1, j) * s * (1 - t) + v(i, j + 1) * (1 - s) * t + v(i + 1, j + 1) * s * t

    for line, height in enumerate((0.2, 0.5, 0.8)):
        mine = [r for r in found if r["line"] == line]
        assert mine and closed(mine)
        assert all(abs(at(r[f"x{k}"], r[f"y{k}"]) - height) < 1e-6 for r in mine for k in (0, 1))
