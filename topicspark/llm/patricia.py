"""A compressed radix trie over byte strings whose terminal nodes name an owner."""

from __future__ import annotations

import os
from collections.abc import Iterator


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes):
        self.label = label
        self.children: dict[int, Node] | None = None
        self.owner = None


class Patricia:
    """Terminal nodes hold whatever ``owner`` the caller puts there; ``size`` counts the label bytes held."""

    def __init__(self):
        self.root = Node(b"")
        self.size = 0
        self.below: dict[int, int] = {}  # label bytes by first byte, one entry for each subtree of the root

    def node(self, key: bytes) -> Node:
        """The terminal node of ``key``, made if it is new; an edge is cut where the key leaves it."""
        at, node = 0, self.root
        while at < len(key):
            children = node.children
            if children is None:
                children = node.children = {}
            first = key[at]
            child = children.get(first)
            if child is None:
                child = children[first] = Node(key[at:])
                self.size += len(key) - at
                self.below[key[0]] = self.below.get(key[0], 0) + len(key) - at
                return child
            label = child.label
            if key.startswith(label, at):
                at += len(label)
                node = child
                continue
            shared = len(os.path.commonprefix((label, key[at : at + len(label)])))
            upper = Node(label[:shared])
            child.label = label[shared:]
            upper.children = {child.label[0]: child}
            children[first] = upper
            at += shared
            node = upper
        return node

    def cut_largest(self) -> Iterator[tuple[bytes, object]]:
        """Take the heaviest subtree of the root out of the trie and give its (key, owner) pairs."""
        if not self.below:
            return
        first = max(self.below, key=self.below.__getitem__)
        self.size -= self.below.pop(first)
        yield from self._walk(self.root.children.pop(first), b"")

    def drain(self) -> Iterator[tuple[bytes, object]]:
        """All (key, owner) pairs, in byte order; the trie is empty afterwards."""
        root, self.root, self.size, self.below = self.root, Node(b""), 0, {}
        yield from self._walk(root, b"")

    @staticmethod
    def _walk(top: Node, before: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(top, before)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.owner is not None:
                yield key, node.owner
            for first in sorted(node.children or (), reverse=True):
                stack.append((node.children[first], key))
