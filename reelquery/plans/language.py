"""The combine language: query ids joined by AND and OR.

AND binds tighter than OR, both associate to the left, operators may be written in any case, a missing closing
parenthesis is tolerated, tokens after a complete expression are ignored, and any other word is a query id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"[()]|[^\s()]+")


@dataclass(frozen=True)
class Leaf:
    query_id: str

    def __str__(self) -> str:
        return self.query_id


@dataclass(frozen=True)
class Op:
    name: str
    left: Leaf | Op
    right: Leaf | Op

    def __str__(self) -> str:
        return f"({self.left} {self.name} {self.right})"


Node = Leaf | Op


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def parse(text: str) -> Node:
    """The expression's tree; ValueError if an operand is missing."""
    rest = tokens(text)[::-1]  # a stack

    def chain(name: str, operand) -> Node:
        node = operand()
        while rest and rest[-1].upper() == name:
            rest.pop()
            node = Op(name, node, operand())
        return node

    def atom() -> Node:
        if not rest:
            raise ValueError("the combine expression ends where a query id is due")
        word = rest.pop()
        if word != "(":
            return Leaf(word)
        node = disjunction()
        if rest and rest[-1] == ")":
            rest.pop()
        return node

    def conjunction() -> Node:
        return chain("AND", atom)

    def disjunction() -> Node:
        return chain("OR", conjunction)

    return disjunction()


def postfix(node: Node) -> list[str]:
    """Operands and operators in evaluation order; operators carry a NUL so that no query id can equal them."""
    if isinstance(node, Leaf):
        return [node.query_id]
    return [*postfix(node.left), *postfix(node.right), "\0" + node.name]


def leaves(node: Node) -> list[str]:
    return [node.query_id] if isinstance(node, Leaf) else [*leaves(node.left), *leaves(node.right)]


def simplify(node: Node) -> Node:
    """Idempotence only (x AND x, x OR x): absorption would change which frames are present."""
    if isinstance(node, Leaf):
        return node
    left, right = simplify(node.left), simplify(node.right)
    return left if left == right else Op(node.name, left, right)
