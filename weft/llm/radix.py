"""An adaptive radix tree over byte keys: nodes grow through four layouts, and single paths are compressed."""

from __future__ import annotations

from collections.abc import Iterator


class Few:
    """Up to ``room`` children (4 or 16): their bytes, sorted, beside the children."""

    __slots__ = ("keys", "nodes", "room")

    def __init__(self, room: int = 4, keys: bytes = b"", nodes: list | None = None):
        self.room, self.keys, self.nodes = room, bytearray(keys), nodes or []

    def get(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.nodes[at]

    def put(self, byte: int, node) -> Few | Indexed:
        at = self.keys.find(byte)
        if at >= 0:
            self.nodes[at] = node
            return self
        if len(self.keys) == self.room:
            grown = Few(16, bytes(self.keys), self.nodes) if self.room == 4 else Indexed(self)
            return grown.put(byte, node)
        at = sum(k < byte for k in self.keys)
        self.keys.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def __iter__(self) -> Iterator:
        return iter(self.nodes)


class Indexed:
    """Up to 48 children: a place for each of 256 bytes in a list of children."""

    __slots__ = ("nodes", "place")

    def __init__(self, few: Few):
        self.place, self.nodes = bytearray(256), list(few.nodes)
        for at, byte in enumerate(few.keys, 1):
            self.place[byte] = at

    def get(self, byte: int):
        at = self.place[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node) -> Indexed | Direct:
        if at := self.place[byte]:
            self.nodes[at - 1] = node
        elif len(self.nodes) == 48:
            return Direct(self).put(byte, node)
        else:
            self.nodes.append(node)
            self.place[byte] = len(self.nodes)
        return self

    def __iter__(self) -> Iterator:
        return (self.nodes[at - 1] for at in self.place if at)


class Direct:
    """Any number of children, one place a byte."""

    __slots__ = ("nodes",)

    def __init__(self, indexed: Indexed):
        self.nodes = [indexed.get(b) for b in range(256)]

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> Direct:
        self.nodes[byte] = node
        return self

    def __iter__(self) -> Iterator:
        return (n for n in self.nodes if n is not None)


class Node:
    """The bytes ``start:end`` of its keys (one compressed path), the key that ends here, and the children behind it.

    The bytes are those of ``key``, any key that runs through the node, so paths hold no copies.
    """

    __slots__ = ("below", "end", "key", "leaf", "start")

    def __init__(self, key: bytes, start: int, end: int, leaf=None):
        self.key, self.start, self.end, self.leaf, self.below = key, start, end, leaf, None

    def add(self, node: Node) -> None:
        self.below = (self.below or Few()).put(node.key[node.start], node)


def shared(a: bytes, b: bytes, start: int, end: int) -> int:
    """Where two keys that agree before ``start`` part, ``end`` at most; halves are compared as wholes."""
    end = min(end, len(a), len(b))
    if a[start:end] == b[start:end]:
        return end
    while end - start > 1:
        mid = (start + end) // 2
        if a[start:mid] == b[start:mid]:
            start = mid
        else:
            end = mid
    return start


class Tree:
    """Keys of bytes, each with one value."""

    def __init__(self):
        self.root = Node(b"", 0, 0)

    def put(self, key: bytes, value) -> None:
        node, parent = self.root, None
        while True:
            at = shared(node.key, key, node.start, node.end)
            if at < node.end:  # the path divides: what is left of it moves down
                upper = Node(key, node.start, at)
                node.start = at
                upper.add(node)
                if parent is None:
                    self.root = upper
                else:
                    parent.add(upper)
                node = upper
            if at == len(key):
                node.leaf = value
                return
            child = node.below.get(key[at]) if node.below else None
            if child is None:
                node.add(Node(key, at, len(key), value))
                return
            node, parent = child, node
