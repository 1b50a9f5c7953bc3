"""Geometry of landmark sets as column expressions, and the 40 named face features.

A point is struct<x,y>, a landmark set an array of points. Everything but the convex hull stays in built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8

#: The places of each region in the 106-point landmark model, in drawing order.
JAW = (0, 24, 23, 22, 21, 20, 19, 18, 32, 31, 30, 29, 28, 27, 26, 25, 17, 1, 9, 10, 11, 12, 13, 14, 15, 16, 2, 3, 4, 5, 6, 7, 8)
LEFT_EYE = tuple(range(33, 43))
LEFT_BROW = tuple(range(43, 52))
MOUTH = tuple(range(52, 72))
NOSE = tuple(range(72, 87))
RIGHT_EYE = tuple(range(87, 97))
RIGHT_BROW = tuple(range(97, 106))
REGIONS = {"jaw": JAW, "left_eye": LEFT_EYE, "left_brow": LEFT_BROW, "mouth": MOUTH, "nose": NOSE, "right_eye": RIGHT_EYE, "right_brow": RIGHT_BROW}


def region(points: Column, places: tuple[int, ...]) -> Column:
    """The region's points, in the order of ``places``."""
    return F.transform(F.array(*[F.lit(p) for p in places]), lambda p: F.element_at(points, p + 1))


def extreme(points: Column, axis: str, greatest: bool = False) -> Column:
    """The point least (or greatest) along an axis; of ties the first."""
    keyed = F.transform(points, lambda p, i: F.struct((-p[axis] if greatest else p[axis]).alias("k"), i.alias("i"), p.alias("p")))
    return F.array_min(keyed)["p"]


def centre(points: Column) -> Column:
    """Mean point."""
    n = F.size(points)
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[axis]) / n
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def _next(points: Column) -> Column:
    return F.concat(F.slice(points, F.lit(2), F.size(points) - 1), F.slice(points, 1, 1))


def polygon_area(points: Column) -> Column:
    """Half the absolute shoelace sum over the points as they come; edges may cross."""
    cross = F.zip_with(points, _next(points), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, c: s + c)) / 2


def perimeter(points: Column) -> Column:
    return F.aggregate(F.zip_with(points, _next(points), distance), F.lit(0.0), lambda s, d: s + d)


def circularity(area: Column, around: Column) -> Column:
    return 4 * F.pi() * area / (F.pow(around, 2) + EPS)


def aspect_ratio(height: Column, width: Column) -> Column:
    return height / (width + EPS)


def quadratic_curvature(points: Column) -> Column:
    """Leading coefficient of the least-squares parabola over x less its mean; null where x takes fewer than three values."""
    n, mean = F.size(points), centre(points)["x"]
    total = lambda f: F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p))
    power = lambda k: total(lambda p: F.pow(p["x"] - mean, k))
    s2, s3, s4 = power(2), power(3), power(4)
    y0, y1, y2 = total(lambda p: p["y"]), total(lambda p: (p["x"] - mean) * p["y"]), total(lambda p: F.pow(p["x"] - mean, 2) * p["y"])
    # normal equations of a, b, c with the first moment zero, by Cramer's rule
    return F.try_divide(n * s2 * y2 - n * s3 * y1 - s2 * s2 * y0, n * s2 * s4 - n * s3 * s3 - s2 * s2 * s2)


def _given(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _chain(points: Column) -> Column:
    """Half of the convex hull of points in order: a fold whose state is the stack of the monotone chain. A new point takes off
    those that do not turn left before it; once one does, the rest of the inner fold leaves the stack as it is."""

    def left(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def push(stack: Column, q: Column) -> Column:
        off = lambda s, _: F.when((F.size(s) >= 2) & (left(F.get(s, F.size(s) - 2), F.get(s, F.size(s) - 1), q) <= 0), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(s)
        return F.concat(F.aggregate(stack, stack, off), F.array(q))

    return F.aggregate(points, F.slice(points, 1, 0), push)


def hull_area(points: Column) -> Column:
    """Area of the convex hull; null where the points do not span one. Points about the first one, so that an offset costs no
    digits."""
    plain = F.transform(points, lambda p: F.struct((p["x"] - points[0]["x"]).cast("double").alias("x"), (p["y"] - points[0]["y"]).cast("double").alias("y")))

    def area(p: Column) -> Column:
        half = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)  # noqa: E731  the last point begins the other half
        around = F.concat(_given(_chain(p), half), _given(_chain(F.reverse(p)), half))
        return F.when(F.size(p) >= 3, F.nullif(_given(around, polygon_area), F.lit(0.0)))

    return F.when(F.size(points) > 0, _given(F.array_sort(F.array_distinct(plain)), area))


def solidity(points: Column) -> Column:
    return polygon_area(points) / (hull_area(points) + EPS)


def measures(points: Column) -> Column:
    """What the plugins need of a region, as one struct: extremes, centre, area, perimeter, curvature, solidity, height."""
    y = F.transform(points, lambda q: q["y"])
    return F.struct(
        extreme(points, "x").alias("left"), extreme(points, "x", True).alias("right"), extreme(points, "y").alias("top"), extreme(points, "y", True).alias("bottom"),
        centre(points).alias("centre"), polygon_area(points).alias("area"), perimeter(points).alias("perimeter"), quadratic_curvature(points).alias("curvature"),
        (F.array_max(y) - F.array_min(y)).alias("height"),
    )


# The names of the 40 features, as the builders below give them.


def _eye(m: Column, side: str) -> dict[str, Column]:
    width, height = distance(m["left"], m["right"]), distance(m["top"], m["bottom"])
    return {
        f"{side} Eye Width": width,
        f"{side} Eye Height": height,
        f"{side} EAR": aspect_ratio(height, width),
        f"{side} Eye Area": m["area"],
        f"{side} Eye Perimeter": m["perimeter"],
        f"{side} Eye Circularity": circularity(m["area"], m["perimeter"]),
        f"{side} Eye Solidity": m["area"] / (m["hull"] + EPS),
    }


def eyes(face: dict[str, Column]) -> dict[str, Column]:
    left, right = face["left_eye"], face["right_eye"]
    out = _eye(left, "Left") | _eye(right, "Right")
    out["Eye Symmetry"] = F.abs(out["Left EAR"] - out["Right EAR"])
    out["Inter-Eye Distance"] = distance(left["centre"], right["centre"])
    return out


def mouth(face: dict[str, Column]) -> dict[str, Column]:
    m = face["mouth"]
    width, opening = distance(m["left"], m["right"]), distance(m["top"], m["bottom"])
    return {
        "Mouth Width": width,
        "Mouth Opening": opening,
        "MAR": aspect_ratio(opening, width),
        "Mouth Area": m["area"],
        "Mouth Perimeter": m["perimeter"],
        "Mouth Circularity": circularity(m["area"], m["perimeter"]),
        "Mouth Solidity": m["area"] / (m["hull"] + EPS),
        "Upper Lip Curvature": m["curvature"],
    }


def _brow(m: Column, side: str) -> dict[str, Column]:
    inner, outer = m["left"], m["right"]  # by x for both brows, not mirrored
    width = distance(inner, outer)
    return {
        f"{side} Brow Width": width,
        f"{side} Brow Height": m["height"],
        f"{side} Brow Ratio": aspect_ratio(m["height"], width),
        f"{side} Brow Slope": F.degrees(F.atan2(outer["y"] - inner["y"], outer["x"] - inner["x"])),
        f"{side} Brow Curvature": m["curvature"],
    }


def brows(face: dict[str, Column]) -> dict[str, Column]:
    left, right = face["left_brow"], face["right_brow"]
    out = _brow(left, "Left") | _brow(right, "Right")
    out["Inner Brow Distance"] = distance(left["left"], right["left"])
    out["Brow Centre Distance"] = distance(left["centre"], right["centre"])
    for name in ("Height", "Ratio", "Slope", "Curvature"):
        a, b = out[f"Left Brow {name}"], out[f"Right Brow {name}"]
        out[f"Eyebrow {name} Symmetry"] = F.abs(F.abs(a) - F.abs(b)) if name == "Slope" else F.abs(a - b)
    return out


#: Feature plugins by name, from the measures of a face's regions; register_plugin adds more.
PLUGINS: dict[str, Callable[[dict[str, Column]], dict[str, Column]]] = {"eyes": eyes, "mouth": mouth, "eyebrows": brows}


def register_plugin(name: str):
    """Decorator that adds a feature plugin; a taken name is an error."""

    def add(builder: Callable[[dict[str, Column]], dict[str, Column]]):
        if name in PLUGINS:
            raise ValueError(f"a feature plugin named {name!r} exists")
        PLUGINS[name] = builder
        return builder

    return add


def face_features(landmarks: DataFrame, id_col: str = "Image", points: str = "pts", enabled: list[str] | None = None) -> DataFrame:
    """Id first, then the features of the enabled plugins in order; rows without landmarks are dropped (see rejected).

    Regions, their measures and the features are three projections, so that each region is measured once.
    """
    face = {r: F.col(f"m_{r}") for r in REGIONS}
    out: dict[str, Column] = {}
    for name in enabled or list(PLUGINS):
        if name not in PLUGINS:
            raise ValueError(f"unknown feature plugin {name!r}")
        for feature, column in PLUGINS[name](face).items():
            if feature in out:
                raise ValueError(f"two plugins give {feature!r}")
            out[feature] = column
    regions = landmarks.where(F.size(points) > 0).select(id_col, *[region(F.col(points), places).alias(f"p_{r}") for r, places in REGIONS.items()])
    hulls = regions.withColumns({f"h_{r}": hull_area(F.col(f"p_{r}")) for r in REGIONS})
    measured = hulls.select(id_col, *[measures(F.col(f"p_{r}")).withField("hull", F.col(f"h_{r}")).alias(f"m_{r}") for r in REGIONS])
    return measured.select(id_col, *[c.alias(n) for n, c in out.items()])


def rejected(landmarks: DataFrame, id_col: str = "Image", points: str = "pts") -> DataFrame:
    """(id, reason) of rows that face_features drops."""
    return landmarks.where((F.col(points).isNull()) | (F.size(points) == 0)).select(id_col, F.lit("no landmarks").alias("reason"))
