"""Chinese-restaurant seatings of Pitman-Yor processes, sampled by Gibbs for many dishes at once.

A restaurant's customers are observed by their dish; what is sampled is how those of a dish share tables. A table's first
customer is one customer of the parent restaurant. Given all other customers, a customer of dish w joins one of w's tables
with weight (its customers - discount), or opens one with weight (strength + discount * tables of the restaurant) times
the parent's probability of w.

One Gibbs step takes a customer, drawn uniformly, out of each dish and seats it again by these weights; the next step
follows from there. Dishes of one restaurant step together, given the restaurant's tables after the step before. Of a dish
of 2 * ``TOGETHER`` customers or more, one in ``TOGETHER`` step together (``MOST`` at most), given those that stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

TOGETHER, MOST = 16, 100_000


@dataclass
class Tables:
    """Customers of each table, and the dish of each; dishes ascend."""

    dish: np.ndarray
    size: np.ndarray

    def counts(self, dishes: int) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each dish."""
        return np.bincount(self.dish, self.size, dishes).astype(np.int64), np.bincount(self.dish, minlength=dishes)

    def of(self, dishes: np.ndarray) -> Tables:
        """The tables of some dishes (ascending), numbered by their place among these."""
        at = np.minimum(np.searchsorted(dishes, self.dish), max(0, len(dishes) - 1))
        mine = dishes[at] == self.dish if len(dishes) else np.zeros(len(self.dish), bool)
        return Tables(at[mine], self.size[mine])

    def opened(self, dishes: np.ndarray) -> Tables:
        """With a new table of one customer for each entry of ``dishes`` (ascending)."""
        at = np.searchsorted(self.dish, dishes, "right")
        return Tables(np.insert(self.dish, at, dishes), np.insert(self.size, at, 1))


def _joined(parts: list[tuple[np.ndarray, Tables]]) -> Tables:
    """Tables of disjoint sets of dishes, each given with the dishes that its numbers stand for."""
    dish, size = (np.concatenate(x) for x in zip(*((who[t.dish], t.size) for who, t in parts), strict=True))
    order = np.argsort(dish, kind="stable")
    return Tables(dish[order], size[order])


class Restaurants:
    """The dishes of many restaurants: each dish's restaurant and its probability in the parent; tables of each restaurant."""

    def __init__(self, restaurant: np.ndarray, parent: np.ndarray, tables: np.ndarray, discount: float, strength: float, rng: np.random.Generator):
        self.restaurant, self.parent, self.tables = restaurant, parent, tables.astype(float)
        self.discount, self.strength, self.rng = discount, strength, rng

    def _opens(self, who: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The odds that a dish's next customer opens a table."""
        new = (self.strength + self.discount * self.tables[self.restaurant[who]]) * self.parent[who]
        return new / (new + np.maximum(customers - self.discount * tables, 0))

    def _count(self, who: np.ndarray, change: np.ndarray) -> None:
        np.add.at(self.tables, self.restaurant[who], change)

    def _drawn(self, ends: np.ndarray, begins: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The table of the customer at a place among its dish's customers."""
        return np.searchsorted(ends, begins + place, "right")

    def arrive(self, seated: Tables, target: np.ndarray) -> Tables:
        """Customers come or go until each dish has its target. Large dishes fill and empty by groups, a tenth at a time."""
        who, done = np.arange(len(target)), []
        while True:
            now, tables = seated.counts(len(who))
            need = target[who] - now
            open_ = need != 0
            if not open_.any():
                break
            if open_.mean() < 0.5:
                done.append((who[~open_], seated.of(np.flatnonzero(~open_))))
                seated, who = seated.of(np.flatnonzero(open_)), who[open_]
                continue
            group = np.sign(need) * np.minimum(np.abs(need), np.maximum(1, now // 10))
            come = np.maximum(group, 0)
            opened = np.where(now > 0, self.rng.binomial(come, self._opens(who, now, tables)), come)
            # the others are spread by the tables' sizes; what is left of a group goes to, or leaves, one drawn table
            spread = group - opened
            each = np.trunc(spread[seated.dish] * (seated.size / np.maximum(now[seated.dish], 1))).astype(np.int64)
            left = spread - np.bincount(seated.dish, each, len(who)).astype(np.int64)
            size = seated.size + each
            drawn = np.flatnonzero(left)
            if len(drawn):
                left_now = np.bincount(seated.dish, size, len(who)).astype(np.int64)
                ends = np.cumsum(size)
                begins = np.cumsum(left_now) - left_now
                k = self._drawn(ends, begins[drawn], (self.rng.random(len(drawn)) * left_now[drawn]).astype(np.int64))
                size[k] += np.maximum(left[drawn], -size[k])
            self._count(who, opened - np.bincount(seated.dish[size == 0], minlength=len(who)))
            seated = Tables(seated.dish[size > 0], size[size > 0]).opened(np.repeat(np.arange(len(who)), opened))
        return _joined([*done, (who, seated)])

    def reseat(self, seated: Tables, dishes: int, rounds: int) -> Tables:
        """Gibbs: as many steps as a dish has customers, ``rounds`` at most; a dish of one customer can't change."""
        now, _ = seated.counts(dishes)
        who, done = np.flatnonzero(now > 1), [(single := np.flatnonzero(now <= 1), seated.of(single))]
        seated = seated.of(who)
        for step in range(rounds):
            now, tables = seated.counts(len(who))
            go = now > step  # a customer of a small dish steps once
            if go.mean() < 0.5 if len(go) else False:
                done.append((who[~go], seated.of(np.flatnonzero(~go))))
                seated, who = seated.of(np.flatnonzero(go)), who[go]
                now, tables = seated.counts(len(who))
                go = np.ones(len(who), bool)
            at = np.flatnonzero(go)
            if not len(at):
                break
            group = np.minimum(np.maximum(1, now[at] // TOGETHER), MOST)
            one = np.repeat(np.arange(len(at)), group)  # each customer's place in ``at``
            nth = np.arange(len(one)) - np.repeat(np.cumsum(group) - group, group)
            width, shift = now[at] // group, (self.rng.random(len(at)) * now[at]).astype(np.int64)
            place = (nth * width[one] + (self.rng.random(len(one)) * width[one]).astype(np.int64) + shift[one]) % now[at[one]]  # all different
            k = self._drawn(np.cumsum(seated.size), (np.cumsum(now) - now)[at[one]], place)
            size = seated.size - np.bincount(k, minlength=len(seated.size))
            closed = np.bincount(seated.dish[size == 0], minlength=len(who))
            self._count(who, -closed.astype(float))
            seated, stay = Tables(seated.dish[size > 0], size[size > 0]), now.copy()
            stay[at] -= group
            odds = np.where(stay[at] > 0, self._opens(who[at], stay[at], (tables - closed)[at]), 1.0)
            opened = self.rng.random(len(one)) < odds[one]
            rest, ends, begins, size = np.flatnonzero(~opened), np.cumsum(seated.size), np.cumsum(stay) - stay, seated.size
            grown = np.zeros(len(size), np.int64)
            while len(rest):  # a table by its customers, accepted by the discount
                d = at[one[rest]]
                other = self._drawn(ends, begins[d], (self.rng.random(len(rest)) * stay[d]).astype(np.int64))
                accepted = self.rng.random(len(rest)) * size[other] < size[other] - self.discount
                grown += np.bincount(other[accepted], minlength=len(size))
                rest = rest[~accepted]
            self._count(who, np.bincount(at[one[opened]], minlength=len(who)).astype(float))
            seated = Tables(seated.dish, size + grown).opened(at[one[opened]])
        return _joined([*done, (who, seated)])
