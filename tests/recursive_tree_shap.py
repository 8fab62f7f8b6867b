"""Path-dependent TreeSHAP by recursion (Lundberg et al., 2018), to compare with."""

import numpy as np


def _extend(path: list, zero: float, one: float, feat: int) -> list:
    path = [list(e) for e in path] + [[feat, zero, one, 1.0 if not path else 0.0]]
    depth = len(path) - 1
    for i in range(depth - 1, -1, -1):
        path[i + 1][3] += one * path[i][3] * (i + 1) / (depth + 1)
        path[i][3] = zero * path[i][3] * (depth - i) / (depth + 1)
    return path


def _unwind(path: list, idx: int) -> list:
    path = [list(e) for e in path]
    depth = len(path) - 1
    one, zero = path[idx][2], path[idx][1]
    nxt = path[depth][3]
    for i in range(depth - 1, -1, -1):
        if one != 0:
            tmp = path[i][3]
            path[i][3] = nxt * (depth + 1) / ((i + 1) * one)
            nxt = tmp - path[i][3] * zero * (depth - i) / (depth + 1)
        else:
            path[i][3] = path[i][3] * (depth + 1) / (zero * (depth - i))
    for i in range(idx, depth):
        path[i][0], path[i][1], path[i][2] = path[i + 1][0], path[i + 1][1], path[i + 1][2]
    return path[:depth]


def _unwound_sum(path: list, idx: int) -> float:
    depth = len(path) - 1
    one, zero = path[idx][2], path[idx][1]
    nxt = path[depth][3]
    total = 0.0
    for i in range(depth - 1, -1, -1):
        if one != 0:
            tmp = nxt * (depth + 1) / ((i + 1) * one)
            total += tmp
            nxt = path[i][3] - tmp * zero * (depth - i) / (depth + 1)
        else:
            total += path[i][3] * (depth + 1) / (zero * (depth - i))
    return total


def tree_shap(x: np.ndarray, tree: dict, phi: np.ndarray, scale: float) -> None:
    """Add ``scale`` x path-dependent TreeSHAP values of one tree for row ``x`` to ``phi``."""
    feat, thr, left, right = tree["feature"], tree["threshold"], tree["left"], tree["right"]
    value, cover = tree["value"], tree["cover"]

    def recurse(node, path, zero, one, parent_feat):
        path = _extend(path, zero, one, parent_feat)
        if left[node] < 0:
            for i in range(1, len(path)):
                w = _unwound_sum(path, i)
                phi[path[i][0]] += scale * w * (path[i][2] - path[i][1]) * value[node]
            return
        f = feat[node]
        hot, cold = (left[node], right[node]) if x[f] <= thr[node] else (right[node], left[node])
        in_zero, in_one = 1.0, 1.0
        for k in range(1, len(path)):
            if path[k][0] == f:
                in_zero, in_one = path[k][1], path[k][2]
                path = _unwind(path, k)
                break
        recurse(hot, path, in_zero * cover[hot] / cover[node], in_one, f)
        recurse(cold, path, in_zero * cover[cold] / cover[node], 0.0, f)

    recurse(0, [], 1.0, 1.0, -1)
