"""Spherical and quadtree formulas as SQL text, in steps that name their results.

Each function returns a list of steps, each a dict of column name -> expression that
refers to columns and to earlier steps. ``apply`` adds them to a DataFrame, ``nest``
wraps them around a SQL query for another engine. The formulas are those of the
public HEALPix papers, for the nested numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = list[dict[str, str]]

_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]
_GATHER = [(1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)]

# Fixed values of the tiling, from the public papers, down to TURN.
#: Ring and longitude offsets of the twelve faces.
JRLL = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
JPLL = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
#: Neighbours SW, W, NW, N, NE, E, SE, S as steps in x and y.
NEAR_X = (-1, -1, 0, 1, 1, 1, 0, -1)
NEAR_Y = (0, 1, 1, 1, 0, -1, -1, -1)
#: The face across each side or corner (S, SE, E, SW, centre, NE, W, NW, N) of each face; -1: none.
ACROSS = (
    (8, 9, 10, 11, -1, -1, -1, -1, 10, 11, 8, 9), (5, 6, 7, 4, 8, 9, 10, 11, 9, 10, 11, 8), (-1, -1, -1, -1, 5, 6, 7, 4, -1, -1, -1, -1),
    (4, 5, 6, 7, 11, 8, 9, 10, 11, 8, 9, 10), (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11), (1, 2, 3, 0, 0, 1, 2, 3, 5, 6, 7, 4),
    (-1, -1, -1, -1, 7, 4, 5, 6, -1, -1, -1, -1), (3, 0, 1, 2, 3, 0, 1, 2, 4, 5, 6, 7), (2, 3, 0, 1, -1, -1, -1, -1, 0, 1, 2, 3),
)
#: What happens to x and y there, by third of the sphere: 1 flips x, 2 flips y, 4 swaps.
TURN = ((0, 0, 3), (0, 0, 6), (0, 0, 0), (0, 0, 5), (0, 0, 0), (5, 0, 0), (0, 0, 0), (6, 0, 0), (3, 0, 0))


def pick(values: tuple[int, ...], index: str, engine: str = "spark") -> str:
    """The value at a 0-based index of a literal list."""
    if engine == "spark":
        return f"array({', '.join(map(str, values))})[cast({index} AS INT)]"
    return f"([{', '.join(map(str, values))}])[cast({index} AS INT) + 1]"


def _spread(x: str, out: str) -> Steps:
    steps, at = [], x
    for k, (shift, mask) in enumerate(_SPREAD):
        name = out if k == len(_SPREAD) - 1 else f"{out}_{k}"
        steps.append({name: f"(({at} | ({at} << {shift})) & {mask})"})
        at = name
    return steps


def _gather(x: str, out: str) -> Steps:
    steps, at = [{f"{out}_s": f"({x} & {0x5555555555555555})"}], f"{out}_s"
    for k, (shift, mask) in enumerate(_GATHER):
        name = out if k == len(_GATHER) - 1 else f"{out}_{k}"
        steps.append({name: f"(({at} | ({at} >> {shift})) & {mask})"})
        at = name
    return steps


def _beside(*lists: Steps) -> Steps:
    """Steps that don't depend on one another, side by side."""
    out: Steps = []
    for steps in lists:
        for k, s in enumerate(steps):
            if k == len(out):
                out.append({})
            out[k] = out[k] | s
    return out


def ang2pix(ra: str, dec: str, order: int, out: str, tag: str = "_h") -> Steps:
    """The cell of a position in degrees, as BIGINT ``out``."""
    n, t = 1 << order, tag
    steps: Steps = [
        {f"{t}z": f"sin(radians(CAST({dec} AS DOUBLE)))", f"{t}tt": f"((((CAST({ra} AS DOUBLE) / 90.0e0) % 4.0e0) + 4.0e0) % 4.0e0)"},
        {
            f"{t}za": f"abs({t}z)", f"{t}nt": f"least(3, CAST(floor({t}tt) AS BIGINT))",
            f"{t}ep": f"CAST(floor({n} * (0.5e0 + {t}tt) - 0.75e0 * {n} * {t}z) AS BIGINT)", f"{t}em": f"CAST(floor({n} * (0.5e0 + {t}tt) + 0.75e0 * {n} * {t}z) AS BIGINT)",
        },
        {
            f"{t}w": f"CASE WHEN {t}za < 0.99e0 THEN {n} * sqrt(3.0e0 * (1.0e0 - {t}za)) ELSE {n} * cos(radians(CAST({dec} AS DOUBLE))) / sqrt((1.0e0 + {t}za) / 3.0e0) END",
            f"{t}tp": f"({t}tt - {t}nt)", f"{t}fp": f"({t}ep >> {order})", f"{t}fm": f"({t}em >> {order})",
        },
        {f"{t}pp": f"least({n - 1}, CAST(floor({t}tp * {t}w) AS BIGINT))", f"{t}pm": f"least({n - 1}, CAST(floor((1.0e0 - {t}tp) * {t}w) AS BIGINT))"},
        {
            f"{t}f": f"CASE WHEN {t}za <= 2.0e0 / 3.0e0 THEN CASE WHEN {t}fp = {t}fm THEN ({t}fp | 4) WHEN {t}fp < {t}fm THEN {t}fp ELSE {t}fm + 8 END WHEN {t}z >= 0 THEN {t}nt ELSE {t}nt + 8 END",
            f"{t}x": f"CASE WHEN {t}za <= 2.0e0 / 3.0e0 THEN ({t}em & {n - 1}) WHEN {t}z >= 0 THEN {n - 1} - {t}pm ELSE {t}pp END",
            f"{t}y": f"CASE WHEN {t}za <= 2.0e0 / 3.0e0 THEN {n - 1} - ({t}ep & {n - 1}) WHEN {t}z >= 0 THEN {n - 1} - {t}pp ELSE {t}pm END",
        },
    ]
    steps += _beside(_spread(f"{t}x", f"{t}sx"), _spread(f"{t}y", f"{t}sy"))
    return [*steps, {out: f"(({t}f << {2 * order}) + {t}sx + ({t}sy << 1))"}]


def pix2xyf(pix: str, order: int, x: str, y: str, face: str, tag: str = "_g") -> Steps:
    """A cell's place in its face."""
    low = f"({pix} & {(1 << 2 * order) - 1})"
    return [*_beside(_gather(low, f"{tag}x"), _gather(f"({low} >> 1)", f"{tag}y")), {x: f"{tag}x", y: f"{tag}y", face: f"({pix} >> {2 * order})"}]


def xyf2pix(x: str, y: str, face: str, order: int, out: str, tag: str = "_i") -> Steps:
    return [*_beside(_spread(x, f"{tag}x"), _spread(y, f"{tag}y")), {out: f"(({face} << {2 * order}) + {tag}x + ({tag}y << 1))"}]


def xyf2ang(x: str, y: str, face: str, ra: str, dec: str, engine: str = "spark", tag: str = "_a") -> Steps:
    """Degrees of a point of a face; ``x`` and ``y`` in [0, 1] are columns."""
    t = tag
    return [
        {f"{t}jr": f"({pick(JRLL, face, engine)} - {x} - {y})"},
        {f"{t}nr": f"CASE WHEN {t}jr < 1 THEN {t}jr WHEN {t}jr > 3 THEN 4 - {t}jr ELSE 1.0e0 END"},
        {
            f"{t}z": f"CASE WHEN {t}jr < 1 THEN 1 - {t}nr * {t}nr / 3.0e0 WHEN {t}jr > 3 THEN {t}nr * {t}nr / 3.0e0 - 1 ELSE (2 - {t}jr) * 2.0e0 / 3.0e0 END",
            f"{t}t": f"(((({pick(JPLL, face, engine)} * {t}nr + {x} - {y}) % 8.0e0) + 8.0e0) % 8.0e0)",
        },
        {ra: f"CASE WHEN {t}nr < 1e-15 THEN 0.0e0 ELSE 45.0e0 * {t}t / {t}nr END", dec: f"degrees(asin(least(1.0e0, greatest(-1.0e0, {t}z))))"},
    ]


def pix2ang(pix: str, order: int, ra: str, dec: str, engine: str = "spark", tag: str = "_c") -> Steps:
    """The centre of a cell in degrees."""
    n = float(1 << order)
    return [*pix2xyf(pix, order, f"{tag}ix", f"{tag}iy", f"{tag}if"), {f"{tag}u": f"(({tag}ix + 0.5e0) / {n!r}e0)", f"{tag}v": f"(({tag}iy + 0.5e0) / {n!r}e0)"}, *xyf2ang(f"{tag}u", f"{tag}v", f"{tag}if", ra, dec, engine)]


def ring2ang(ring: str, order: int, ra: str, dec: str, tag: str = "_r") -> Steps:
    """The centre, in degrees, of a cell that is numbered along rings from the north. Near the poles, rings
    of 4, 8, 12 ... cells; between them rings of ``4 * nside``, every other shifted by half a cell."""
    n, t = 1 << order, tag
    cap, last = 2 * n * (n - 1), 12 * n * n
    south = f"{ring} >= {last - cap}"
    return [
        {f"{t}k": f"CASE WHEN {south} THEN {last - 1} - {ring} ELSE {ring} END"},
        {f"{t}g": f"CAST(floor((1.0e0 + sqrt(1.0e0 + 2.0e0 * {t}k)) / 2.0e0) AS BIGINT)"},
        # The root may be one off for large numbers.
        {f"{t}i": f"CASE WHEN 2 * {t}g * ({t}g - 1) > {t}k THEN {t}g - 1 WHEN 2 * {t}g * ({t}g + 1) <= {t}k THEN {t}g + 1 ELSE {t}g END"},
        {f"{t}j": f"({t}k - 2 * {t}i * ({t}i - 1))", f"{t}e": f"({ring} - {cap})"},
        {f"{t}m": f"CAST(floor({t}e / {4.0 * n!r}e0) AS BIGINT)"},
        {f"{t}q": f"({t}e - {4 * n} * {t}m)"},
        {
            f"{t}d": f"90.0e0 - 2.0e0 * degrees(asin(least(1.0e0, {t}i / ({float(n)!r}e0 * sqrt(6.0e0)))))",
            f"{t}a": f"(CASE WHEN {south} THEN 4 * {t}i - 1 - {t}j ELSE {t}j END + 0.5e0) * 90.0e0 / greatest({t}i, 1)",
        },
        {
            ra: f"CASE WHEN {t}k < {cap} THEN {t}a ELSE ({t}q + CASE WHEN {t}m % 2 = 0 THEN 0.5e0 ELSE 0.0e0 END) * CAST({90.0 / n!r} AS DOUBLE) END",
            dec: f"CASE WHEN {t}k < {cap} THEN CASE WHEN {south} THEN -{t}d ELSE {t}d END ELSE degrees(asin(greatest(-1.0e0, least(1.0e0, 2.0e0 / 3.0e0 - {t}m * CAST({2 / (3 * n)!r} AS DOUBLE))))) END",
        },
    ]


def neighbour(pix: str, order: int, k: int, out: str, engine: str = "spark", tag: str = "_n") -> Steps:
    """Neighbour ``k`` of 0 to 7 (SW, W, NW, N, NE, E, SE, S) of a cell; null where there is none."""
    n, t = 1 << order, f"{tag}{k}"
    flat = tuple(x for row in ACROSS for x in row)
    turn = tuple(x for row in TURN for x in row)
    return [
        *pix2xyf(pix, order, f"{t}x", f"{t}y", f"{t}f", f"{t}g"),
        {f"{t}a": f"({t}x + ({NEAR_X[k]}))", f"{t}b": f"({t}y + ({NEAR_Y[k]}))"},
        {
            f"{t}nb": f"(4 + CASE WHEN {t}a < 0 THEN -1 WHEN {t}a >= {n} THEN 1 ELSE 0 END + CASE WHEN {t}b < 0 THEN -3 WHEN {t}b >= {n} THEN 3 ELSE 0 END)",
            f"{t}c": f"({t}a & {n - 1})", f"{t}d": f"({t}b & {n - 1})", f"{t}f4": f"({t}f >> 2)",
        },
        {f"{t}to": pick(flat, f"({t}nb * 12 + {t}f)", engine), f"{t}tr": pick(turn, f"({t}nb * 3 + {t}f4)", engine)},
        {f"{t}p": f"CASE WHEN ({t}tr & 1) > 0 THEN {n - 1} - {t}c ELSE {t}c END", f"{t}q": f"CASE WHEN ({t}tr & 2) > 0 THEN {n - 1} - {t}d ELSE {t}d END"},
        {f"{t}r": f"CASE WHEN ({t}tr & 4) > 0 THEN {t}q ELSE {t}p END", f"{t}s": f"CASE WHEN ({t}tr & 4) > 0 THEN {t}p ELSE {t}q END"},
        *xyf2pix(f"{t}r", f"{t}s", f"CAST(greatest({t}to, 0) AS BIGINT)", order, f"{t}o", f"{t}i"),
        {out: f"CASE WHEN {t}to >= 0 THEN {t}o END"},
    ]


def separation(ra1: str, dec1: str, ra2: str, dec2: str) -> str:
    """Degrees between two positions, stable at all distances (Vincenty)."""
    d, a, b = f"radians({ra2} - {ra1})", f"radians({dec1})", f"radians({dec2})"
    return (
        f"degrees(atan2(sqrt(pow(cos({b}) * sin({d}), 2) + pow(cos({a}) * sin({b}) - sin({a}) * cos({b}) * cos({d}), 2)), "
        f"sin({a}) * sin({b}) + cos({a}) * cos({b}) * cos({d})))"
    )


def all_neighbours(pix: str, order: int, engine: str = "spark") -> tuple[Steps, list[str]]:
    names = [f"near{k}" for k in range(8)]
    return _beside(*(neighbour(pix, order, k, names[k], engine) for k in range(8))), names


def apply(df: DataFrame, steps: Steps, keep: list[str]) -> DataFrame:
    """``df`` with the columns ``keep`` of the steps. The steps stay projections of their
    own where a result is used more than once, all in one generated stage.

    The results leave through a generator of one row: predicates and join keys on them
    are then tested after it. Pushed through the steps, a predicate would hold every step's
    expression as often as its result is used, which doubles from step to step.
    """
    names = df.columns
    for s in steps:
        df = df.withColumns({k: F.expr(v) for k, v in s.items()})
    return df.select(*(c for c in names if c not in keep), F.inline(F.array(F.struct(*keep))))


def nest(query: str, steps: Steps) -> str:
    """The query with all steps' columns."""
    for s in steps:
        query = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in s.items())} FROM ({query})"
    return query
