"""What a worker remembers between texts: keys in two generations."""

from __future__ import annotations


class Memory:
    """Values of the keys met lately, about 2 x ``size`` of them at most.

    When the young generation is full it becomes the old one, and the old one
    goes. A key of the old generation that is met again moves to the young one,
    so frequent keys are never forgotten and rare ones are, whatever the order.
    """

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def lacking(self, keys: set) -> set:
        """The keys to be learned; all others are in ``young`` afterwards."""
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        missing = keys.difference(self.young)
        if missing and self.old:
            old = self.old
            known = {key: old[key] for key in missing if key in old}
            self.young.update(known)
            missing.difference_update(known)
        return missing

    def forget(self, keys) -> None:
        """Drop keys that are too long to be kept."""
        for key in keys:
            del self.young[key]
