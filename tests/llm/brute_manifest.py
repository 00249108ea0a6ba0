"""A plain-loop version of the manifest."""

from __future__ import annotations

import hashlib
import zlib


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def way(tree, i, fanout):
    """(left, right) siblings of each level above place i."""
    steps = []
    for nodes in tree[:-1]:
        start = i - i % fanout
        steps.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + fanout])))
        i //= fanout
    return steps


def brute(rows, fanout=2):
    """Rows (doc_id, source, lang, n_chars, text) -> rows of op12."""
    order = lambda x: (x is not None, (x.encode() if isinstance(x, str) else x) if x is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((order(r[0]), digest(r), r))
    langs = sorted(groups, key=order)
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda x: x[:2])
        trees[g] = levels([x[1] for x in groups[g]], fanout)
    top = levels([trees[g][-1][0] for g in langs], fanout) if langs else []
    out = []
    for k, g in enumerate(langs):
        for i, (_, leaf, r) in enumerate(groups[g]):
            steps = way(trees[g], i, fanout) + way(top, k, fanout)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = digest([*r[:3], r[3] + 1, r[4]])
            for a, b in steps:
                node = sha(a + node + b)
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out
