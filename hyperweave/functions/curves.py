"""Space-filling curves: lattice cells in curve order.

The region that a curve fills depends on a node count and the lattice alone, so it is chosen on the
driver. Serpentine, Morton and cyclic quadtree cells are closed forms over ``range`` (bit arithmetic in
the plan); the generalised Hilbert curve is a recursion over rectangles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GraphError


def squareish_region(nodes: int, width: int, height: int, multiple: int = 1) -> tuple[int, int]:
    """The rectangle within the lattice that holds ``nodes``: least |w - h|, then least area, then least w."""
    if nodes > width * height:
        raise GraphError("the lattice is too small for the nodes")
    if nodes == 0:
        return 0, 0
    step = max(multiple, 1)
    up = lambda v: -(-v // step) * step
    widest = min(width, max(nodes, step)) // step * step
    fits = [(abs(w - h), w * h, w, h) for w in range(step, widest + 1, step) if (h := up(-(-nodes // w))) <= height]
    if not fits:
        raise GraphError("no region of this multiple holds the nodes")
    return min(fits)[2:]


def dyadic_region(nodes: int, width: int, height: int, prefer_vertical: bool = True) -> tuple[int, int]:
    """A compact rectangle with a power-of-two side; the squarish one if none fits.

    Order of preference: the other side exceeds the power of two least, sides differ least, least
    area, then the preferred orientation, then the order heights before widths, rising.
    """
    if nodes > width * height:
        raise GraphError("the lattice is too small for the nodes")
    if nodes == 0:
        return 0, 0
    found = []
    for power_is_height, most in ((True, height), (False, width)):
        side = 1
        while side <= most:
            other = -(-nodes // side)
            w, h = (other, side) if power_is_height else (side, other)
            if w <= width and h <= height:
                found.append(((max(other - side, 0), abs(w - h), w * h, power_is_height != prefer_vertical, len(found)), (w, h)))
            side *= 2
    return min(found)[1] if found else squareish_region(nodes, width, height)


def _bits(side: int) -> int:
    return max(side - 1, 0).bit_length()


def _cells(spark: SparkSession, nodes: int, w: int, h: int, decode) -> DataFrame:
    """The first ``nodes`` cells inside w x h, by code over the enclosing power-of-two square."""
    from ..tables import prefix_sums

    levels = _bits(max(w, h))
    x, y = decode(F.col("id"), levels)
    cells = spark.range(1 << 2 * levels).select(F.col("id").alias("code"), x.cast("int").alias("x"), y.cast("int").alias("y")).where(F.col("x") < w).where(F.col("y") < h)
    return prefix_sums(cells, ["code"], {}).where(F.col("row") < nodes).select(F.col("row").alias("idx"), "x", "y")


def snake(spark: SparkSession, nodes: int, width: int, height: int, vertical_first: bool = True) -> DataFrame:
    """(idx, x, y): back and forth along columns (or rows)."""
    w, h = dyadic_region(nodes, width, height, vertical_first)
    length = max(h if vertical_first else w, 1)
    line, at = F.floor(F.col("id") / length).cast("bigint"), F.col("id") % length
    along = F.when(line % 2 == 0, at).otherwise(length - 1 - at)
    x, y = (line, along) if vertical_first else (along, line)
    return spark.range(nodes).select(F.col("id").alias("idx"), x.cast("int").alias("x"), y.cast("int").alias("y"))


def zorder(spark: SparkSession, nodes: int, width: int, height: int) -> DataFrame:
    """(idx, x, y) in Morton order."""

    def decode(code: Column, levels: int):
        bit = lambda at, to: F.shiftleft(F.shiftright(code, at).bitwiseAND(F.lit(1)), to)
        total = lambda odd: sum((bit(2 * k + odd, k) for k in range(levels)), F.lit(0))
        return total(0), total(1)

    return _cells(spark, nodes, *dyadic_region(nodes, width, height), decode)


def quad(spark: SparkSession, nodes: int, width: int, height: int) -> DataFrame:
    """(idx, x, y): each 2 x 2 block runs round as (0,0), (0,1), (1,1), (1,0)."""

    def decode(code: Column, levels: int):
        digit = lambda k: F.shiftright(code, 2 * k).bitwiseAND(F.lit(3))
        x = sum((F.shiftleft(F.shiftright(digit(k), 1), k) for k in range(levels)), F.lit(0))
        y = sum((F.shiftleft(F.shiftright(digit(k), 1).bitwiseXOR(digit(k).bitwiseAND(F.lit(1))), k) for k in range(levels)), F.lit(0))
        return x, y

    return _cells(spark, nodes, *dyadic_region(nodes, width, height), decode)


#: A rectangle of the Hilbert curve: corner (x, y), the vectors (ax, ay) and (bx, by) of its major and minor
#: side, and how many cells come before it.
_RECTANGLE = ("x", "y", "ax", "ay", "bx", "by", "before")
#: Columns that the split of a rectangle uses: side lengths, unit steps, half sides (towards zero).
_SIDES = (
    "abs(ax + ay) AS a", "abs(bx + by) AS b", "cast(sign(ax) AS bigint) AS ux", "cast(sign(ay) AS bigint) AS uy", "cast(sign(bx) AS bigint) AS vx", "cast(sign(by) AS bigint) AS vy",
    "ax div 2 AS hx", "ay div 2 AS hy", "bx div 2 AS kx", "by div 2 AS ky",
)


def _split(rectangles: DataFrame) -> DataFrame:
    """Each rectangle as two or three smaller ones in the order of the curve; lines stay.

    A rectangle more than one and a half times as long as wide is halved across; any other becomes one
    along the minor side, one along the whole major side, and one back. A half of odd length grows by one.
    The places of the parts follow from their areas, so all rectangles of a level are split at once.
    """
    r = rectangles.selectExpr("*", *_SIDES)
    odd_a, odd_b = "(abs(hx + hy) % 2 = 1 AND a > 2)", "(abs(kx + ky) % 2 = 1 AND b > 2)"
    r = r.selectExpr("*", f"hx + if({odd_a}, ux, 0) AS mx", f"hy + if({odd_a}, uy, 0) AS my", f"kx + if({odd_b}, vx, 0) AS nx", f"ky + if({odd_b}, vy, 0) AS ny")
    part = lambda *values: "struct(" + ", ".join(f"cast({v} AS bigint) AS {n}" for v, n in zip(values, _RECTANGLE)) + ")"
    line = part(*_RECTANGLE)
    halves = (part("x", "y", "mx", "my", "bx", "by", "before"), part("x + mx", "y + my", "ax - mx", "ay - my", "bx", "by", "before + abs(mx + my) * b"))
    first, whole = "abs(nx + ny) * abs(hx + hy)", "a * (b - abs(nx + ny))"
    thirds = (
        part("x", "y", "nx", "ny", "hx", "hy", "before"), part("x + nx", "y + ny", "ax", "ay", "bx - nx", "by - ny", f"before + {first}"),
        part("x + ax - ux + nx - vx", "y + ay - uy + ny - vy", "-nx", "-ny", "hx - ax", "hy - ay", f"before + {first} + {whole}"),
    )
    parts = f"CASE WHEN a = 1 OR b = 1 THEN array({line}) WHEN 2 * a > 3 * b THEN array({', '.join(halves)}) ELSE array({', '.join(thirds)}) END"
    return r.selectExpr(f"explode({parts}) AS r").select("r.*")


def hilbert(spark: SparkSession, nodes: int, width: int, height: int) -> DataFrame:
    """(idx, x, y) along the generalised Hilbert curve over the dyadic region: rectangles are split level by level, then lines become cells."""
    w, h = dyadic_region(nodes, width, height, height >= width)
    sides = (w, 0, 0, h) if w >= h else (0, h, w, 0)
    level = spark.range(1).selectExpr("0L AS x", "0L AS y", *[f"{v}L AS {n}" for v, n in zip(sides, _RECTANGLE[2:6])], "0L AS before")
    for k in range(_bits(w) + _bits(h) + 2):  # a split at least halves one side, up to one cell
        level = _split(level).where(F.col("before") < nodes)
        if k == 6:
            level = level.repartition(_RECTANGLE[0], _RECTANGLE[1])
    lines = level.selectExpr("*", *_SIDES).selectExpr("x", "y", "before", "if(b = 1, a, b) AS n", "if(b = 1, ux, vx) AS dx", "if(b = 1, uy, vy) AS dy")
    cells = lines.selectExpr("*", "explode(sequence(0L, n - 1)) AS k").selectExpr("before + k AS idx", "cast(x + k * dx AS int) AS x", "cast(y + k * dy AS int) AS y")
    return cells.where(F.col("idx") < nodes)


#: Curves by their names on the command line.
CURVES = {"hilb": hilbert, "snak": snake, "zord": zorder, "quad": quad}


def curve(spark: SparkSession, name: str, nodes: int, width: int, height: int) -> DataFrame:
    if name not in CURVES:
        raise GraphError(f"unknown curve {name!r}; known: {', '.join(CURVES)}")
    return CURVES[name](spark, nodes, width, height)
