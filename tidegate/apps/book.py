"""The open orders of one security."""

from __future__ import annotations

from heapq import heappop, heappush


class Book:
    """Resting buy and sell orders, best price first, then oldest."""

    def __init__(self):
        self.buys: list[list] = []
        self.sells: list[list] = []
        self.arrivals = 0

    def add(self, order_no: int, side: str, cents: int, volume: int) -> list[tuple[int, int, int, int]]:
        """Match an order and rest what is left; returns (buy order, sell order, price, volume) trades."""
        own, other, sign = (self.buys, self.sells, 1) if side == "B" else (self.sells, self.buys, -1)
        trades = []
        while volume and other and sign * (cents - abs(other[0][0])) >= 0:
            best = other[0]
            traded = min(volume, best[3])
            pair = (order_no, best[2]) if side == "B" else (best[2], order_no)
            trades.append((*pair, abs(best[0]), traded))
            volume -= traded
            best[3] -= traded
            if not best[3]:
                heappop(other)
        if volume:
            self.arrivals += 1
            heappush(own, [-sign * cents, self.arrivals, order_no, volume])
        return trades
