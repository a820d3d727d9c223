"""Fitted MLlib trees as SQL expressions, so that they score array elements inside one projection."""

from __future__ import annotations

from collections.abc import Callable


def _branch(node, features: str, leaf: Callable) -> str:
    """The expression of the tree below this node; ``features`` is the SQL of an array of doubles."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{float(leaf(node))!r}D"
    split = node.split()
    left, right = (_branch(n, features, leaf) for n in (node.leftChild(), node.rightChild()))
    return f"(CASE WHEN {features}[{split.featureIndex()}] <= {float(split.threshold())!r}D THEN {left} ELSE {right} END)"


def trees(model, features: str, leaf: Callable = lambda node: node.prediction()) -> list[str]:
    """One SQL expression for each tree of a fitted model."""
    return [_branch(tree.rootNode(), features, leaf) for tree in model._java_obj.trees()]


def _share(node) -> float:
    """The share of a leaf's training rows that are of class 1."""
    stats = list(node.impurityStats().stats())
    return stats[1] / sum(stats)


def forest_probability(model, features: str) -> str:
    """The probability of class 1 that a two-class random forest gives: its leaves' mean share."""
    each = trees(model, features, _share)
    return f"(({' + '.join(each)}) / {len(each)}D)"


def boosted_margin(model, features: str) -> str:
    """The weighted sum of gradient-boosted trees (positive: class 1)."""
    each = [f"{float(w)!r}D * {t}" for w, t in zip(model.treeWeights, trees(model, features), strict=True)]
    return f"({' + '.join(each)})"
