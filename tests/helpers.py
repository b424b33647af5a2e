"""Units for tests: written down as ``project:path#line``, or drawn at random, with vectors on a circle."""

import math
import random

COLUMNS = {
    "unit_idx": "bigint", "project": "string", "relative_path": "string", "language": "string", "kind": "string", "name": "string", "scope": "string", "start_byte": "bigint", "end_byte": "bigint",
    "start_line": "bigint", "end_line": "bigint", "body_node_count": "bigint", "body_hash": "string", "vector": "array<double>",
}


def direction(degrees, lift=0.0):
    """A unit vector at an angle in the plane, lifted out of it by another angle."""
    a, b = math.radians(degrees), math.radians(lift)
    return [math.cos(a) * math.cos(b), math.sin(a) * math.cos(b), math.sin(b)]


def entry(place, body, vector=None, **more):
    """One unit of three lines; other columns by name."""
    project, _, where = place.partition(":")
    path, _, line = where.partition("#")
    line = int(line or 1)
    row = {"project": project, "relative_path": path, "language": "go", "kind": "function", "name": "work", "scope": None, "start_byte": 31 * line, "end_byte": 31 * (line + 3) - 1, "start_line": line, "end_line": line + 2}
    return row | {"body_node_count": 40, "body_hash": body, "vector": vector} | more


def table(spark, rows):
    """The units as a DataFrame, numbered in their order."""
    return spark.createDataFrame([tuple((row | {"unit_idx": i})[c] for c in COLUMNS) for i, row in enumerate(rows)], ", ".join(f"{c} {t}" for c, t in COLUMNS.items()))


def drawn(seed, n, projects=("one",)):
    """Random units: few directories, names and bodies, so that copies, overlaps, tests and helpers occur."""
    rng = random.Random(seed)
    bodies = {f"body{i}": (direction(rng.choice([0, 40, 80, 200]) + rng.uniform(-14, 14), rng.uniform(-6, 6)) if rng.random() < 0.95 else None, rng.choice([6, 19, 20, 55])) for i in range(max(2, n * 2 // 3))}
    rows = []
    for _ in range(n):
        body = rng.choice(sorted(bodies))
        vector, nodes = bodies[body]
        folder = rng.choice(["core/io", "core/net", "core", "shop/cart", "shop/Util", "shop/tests", "", "web/lib/js"])
        file = rng.choice(["read.go", "read_test.go", "write.go", "form.spec.go"])
        place = f"{rng.choice(projects)}:{folder + '/' if folder else ''}{file}#{rng.randint(1, 300)}"
        rows.append(entry(place, body, vector, body_node_count=nodes, name=rng.choice(["Open", "open", "openAll", "close"]), scope=rng.choice([None, "A", "B", "C", "tests.x"]), language=rng.choice(["go", "rust"])))
    return rows
