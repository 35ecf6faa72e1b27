"""A cell as a plain value: an order and a number along the nested curve."""

from __future__ import annotations

from typing import NamedTuple

from celestile.functions import healpix as hp


class Pixel(NamedTuple):
    """A pair ``(order, pixel)`` that prints as text; made by ``as_pixel``, which checks it."""

    order: int
    pixel: int

    def __str__(self) -> str:
        return f"Order: {self.order}, Pixel: {self.pixel}"

    __repr__ = __str__

    @property
    def directory(self) -> int:
        return self.pixel - self.pixel % 10000

    def lower(self, steps: int) -> Pixel:
        """The ancestor ``steps`` orders up."""
        if not 0 <= steps <= self.order:
            raise ValueError(f"{self} has no cell {steps} orders up")
        return Pixel(self.order - steps, self.pixel >> 2 * steps)

    def higher(self, steps: int) -> list[Pixel]:
        """The descendants ``steps`` orders down."""
        if steps < 0 or self.order + steps > hp.MAX_ORDER:
            raise ValueError(f"{self} has no cells {steps} orders down")
        first = self.pixel << 2 * steps
        return [Pixel(self.order + steps, first + k) for k in range(1 << 2 * steps)]


def as_pixel(value) -> Pixel:
    """A cell from a pair; fails for anything else and for orders past 29."""
    if not isinstance(value, tuple):
        raise TypeError(f"a cell is a pair (order, pixel), not {type(value).__name__}")
    if len(value) != 2:
        raise ValueError(f"a cell is an order and a pixel, not {len(value)} values")
    order, pixel = map(int, value)
    if order > hp.MAX_ORDER:
        raise ValueError(f"orders end at {hp.MAX_ORDER}, not {order}")
    return Pixel(order, pixel)
