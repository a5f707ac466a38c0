"""Piecewise score curves as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Piece:
    """From the previous piece's end up to ``to``: the score goes from ``a`` to ``b`` along t ** power.

    ``closed`` says that ``to`` itself still belongs to the piece.
    """

    to: float
    a: float
    b: float
    power: float = 1.0
    closed: bool = True


@dataclass(frozen=True)
class Curve:
    """Pieces in rising order from ``start``; ``before`` and ``after`` hold outside; null stays null unless ``missing`` is given."""

    start: float
    pieces: tuple[Piece, ...]
    before: float
    after: float
    start_closed: bool = True
    missing: float | None = None

    def of(self, x: Column) -> Column:
        """The score of a column. NaN is taken for missing."""
        x = F.when(~F.isnan(x), x)
        out = F.when(x < self.start if self.start_closed else x <= self.start, F.lit(self.before))
        begin = self.start
        for p in self.pieces:
            inside = x <= p.to if p.closed else x < p.to
            if p.a == p.b:
                value: Column = F.lit(p.a)
            else:
                t = (x - begin) / (p.to - begin)
                value = p.a + (p.b - p.a) * (F.pow(t, p.power) if p.power != 1.0 else t)
            out = out.when(inside, value)
            begin = p.to
        out = out.when(x.isNotNull(), F.lit(self.after))
        return out.otherwise(F.lit(self.missing) if self.missing is not None else F.lit(None).cast("double"))


# The knots of the criterion curves.
ALTITUDE = Curve(150.0, (Piece(200.0, 0.0, 1.0, closed=False), Piece(600.0, 1.0, 1.0), Piece(900.0, 1.0, 0.0)), 0.0, 0.0)
SLOPE = Curve(
    0.0,
    (Piece(15.0, 1.0, 1.0), Piece(30.0, 1.0, 0.55), Piece(40.0, 0.55, 0.15, 0.7), Piece(50.0, 0.15, 0.0)),
    1.0,
    0.0,
    missing=1.0,
)
ROUGHNESS = Curve(0.0, (Piece(3.0, 1.0, 1.0), Piece(12.0, 1.0, 0.0, 0.8)), 1.0, 0.0, missing=1.0)
TWI = Curve(
    3.0,
    (
        Piece(6.0, 0.10, 1.0, 0.6, closed=False),
        Piece(10.0, 1.0, 1.0),
        Piece(14.0, 1.0, 0.10, 1.5),
        Piece(18.0, 0.10, 0.0),
    ),
    0.10,
    0.0,
)
WATER = Curve(
    0.0,
    (Piece(5.0, 0.3, 0.5, closed=False), Piece(80.0, 1.0, 1.0), Piece(1000.0, 1.0, 0.0, 0.8)),
    0.3,
    0.0,
    start_closed=False,
)
URBAN = Curve(15.0, (Piece(100.0, 0.05, 0.6, closed=False), Piece(250.0, 0.6, 1.0, closed=False)), 0.0, 1.0, missing=1.0)
CONTACT = Curve(0.0, (Piece(50.0, 1.0, 1.0), Piece(200.0, 1.0, 0.5), Piece(500.0, 0.5, 0.2)), 1.0, 0.2, missing=0.2)
EDGE = Curve(0.0, (Piece(5.0, 1.0, 1.0), Piece(20.0, 1.0, 0.5), Piece(50.0, 0.5, 0.1)), 1.0, 0.1, missing=0.1)
CANOPY = Curve(
    0.0,
    (
        Piece(20.0, 0.4, 0.4, closed=False),
        Piece(40.0, 0.8, 0.8, closed=False),
        Piece(70.0, 1.0, 1.0, closed=False),
        Piece(90.0, 0.6, 0.6, closed=False),
    ),
    0.4,
    0.2,
)


def aspect_score(aspect: Column, slope: Column) -> Column:
    """Best towards 170 degrees; flat ground scores 0.85 whatever its bearing."""
    return F.when(slope < 5, 0.85).when(aspect.isNotNull(), 0.65 + 0.35 * F.cos(F.radians(aspect - 170.0)))


def ground_cover_score(slope: Column) -> Column:
    return F.when(slope >= 45, 0.15).otherwise(0.20)
