"""A direct fold of events into a book, to hold the windows against."""


class Book:
    def __init__(self):
        self.orders, self.levels = {}, {}

    def add(self, side, price, size):
        self.levels[side, price] = self.levels.get((side, price), 0) + size

    def take(self, side, price, size):
        if (side, price) in self.levels:
            left = self.levels[side, price] - size
            if left > 0:
                self.levels[side, price] = left
            else:
                del self.levels[side, price]

    def apply(self, action, order, side=0, price=None, size=0):
        known, valid = self.orders.get(order), side != 0 and price is not None
        if action == "R":
            self.orders, self.levels = {}, {}
        elif action == "C" and known:
            if known[2] > size:
                self.take(known[0], known[1], known[2] - size)
            if size:
                self.orders[order] = (*known[:2], size)
            else:
                del self.orders[order]
        elif action == "M" and known:
            self.take(*known)
            self.orders[order] = (side or known[0], known[1] if price is None else price, size)
            self.add(*self.orders[order])
        elif action in "AM" and valid:
            self.add(side, price, size)
            self.orders[order] = (side, price, size)
