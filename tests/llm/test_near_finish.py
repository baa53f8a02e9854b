"""Nodes of near copies that stay large; run as a script, it measures recall by depth."""

from __future__ import annotations

import numpy as np

from prosemill.llm import neardup
from prosemill.llm import textops as T


def variants(rng, base: list[str], n: int, changes: tuple[int, ...], tag: str) -> list[str]:
    """Distinct copies of a text with some words changed."""
    out = []
    for i in range(n):
        words = list(base)
        for k, at in enumerate(rng.choice(len(base), rng.choice(changes), replace=False)):
            words[at] = f"{tag}{i}x{k}"
        out.append(" ".join(words))
    return out


def sets_of(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    return neardup.shingle_sets(T.texts(pa.array(items)), 5)


def brute(items: list[str], percent: int) -> tuple[list[int], int]:
    """Component of every text by comparing all pairs, and the number of links."""
    g, bounds = sets_of(items)
    sets = [g[a:e] for a, e in zip(bounds[:-1], bounds[1:], strict=True)]
    both, n = neardup.intersections(sets), np.diff(bounds)
    a, b = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
    return neardup._roots_of(len(items), a, b).tolist(), len(a)


def test_nodes_that_stay_large_are_compared_whole(spark):
    """Pairs of near copies of one text: partners meet in the node, but the rest of the node is below the threshold."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(200)]
    items = []
    for i, text in enumerate(variants(rng, base, 150, (6, 7, 8), "v")):
        words = text.split(" ")
        words[int(rng.integers(200))] = f"other{i}"
        items += [text, " ".join(words)]
    want, links = brute(items, 85)
    assert links >= 140 and len(set(want)) > 100
    df = spark.createDataFrame(list(enumerate(items)), "doc_id bigint, text string")
    for limits in ({"node_limit": 16}, {"node_shingles": 3000}):
        rules = neardup.JoinRules(percent=85, max_depth=0, **limits)
        got = {r.doc_id: r.component_id for r in neardup.link_classes(df, rules=rules).collect()}
        assert [got[i] for i in range(len(items))] == want


def recall_by_depth(n: int = 12_000, trees: int = neardup.JoinRules().trees, seed: int = 3, sample: int = 3000) -> float:
    """Share of pairs at 0.85 to 0.88 that have met in a small node, or are together in a large one, after each level."""
    rng, rules = np.random.default_rng(seed), neardup.JoinRules(percent=85, trees=trees)
    items = variants(rng, [f"w{k}" for k in range(150)], n, (1, 2, 3), "v")
    g, bounds = sets_of(items)
    minima = neardup.minwise(g, bounds)
    size, pairs = np.diff(bounds), []
    sets = [g[a:e] for a, e in zip(bounds[:-1], bounds[1:], strict=True)]
    pick = rng.choice(n, 3000, replace=False)
    both = neardup.intersections([sets[i] for i in pick])
    j = both / (size[pick][:, None] + size[pick][None, :] - both)
    a, b = np.nonzero(np.triu((j >= 0.85) & (j < 0.88), 1))
    at = rng.choice(len(a), min(sample, len(a)), replace=False)
    pairs = list(zip(pick[a[at]].tolist(), pick[b[at]].tolist(), strict=True))
    keys, member = [], []
    for tree, c in neardup._root_coordinates(trees):
        keys.append(T.mix(T.mix(np.full(n, tree << 8, np.uint64) + np.uint64(c << 16)) + T.mix(minima[:, c].astype(np.uint64))))
        member.append(np.arange(n))
    keys, member = np.concatenate(keys), np.concatenate(member)
    short = (minima & np.uint32(0xFF)).astype(np.uint8)
    met = np.zeros(len(pairs), bool)
    wanted = {i for p in pairs for i in p}

    def together(keys, member):
        of: dict[int, set[int]] = {}
        for k, m in zip(keys.tolist(), member.tolist(), strict=True):
            if m in wanted:
                of.setdefault(m, set()).add(k)
        return np.array([bool(of.get(x, set()) & of.get(y, set())) for x, y in pairs])

    print(f"{n} variants, {len(pairs)} pairs")
    for depth in range(rules.max_depth + 1):
        if depth:
            own, grown = neardup._children(keys, short[member])
            rows = np.unique(np.stack((grown, member[own].astype(np.uint64))), axis=1)
            keys, member = rows[0], rows[1].astype(np.int64)
        _, place, count = np.unique(keys, return_inverse=True, return_counts=True)
        large = count[place] > rules.node_limit
        met |= together(keys[~large], member[~large])
        keys, member = keys[large], member[large]
        print(depth, "recall", round(float((met | together(keys, member)).mean()), 4), "large nodes", int((count > rules.node_limit).sum()), "members", len(keys), flush=True)
        if not len(keys):
            break
    return float((met | together(keys, member)).mean())


def test_recall_of_links_at_production_rules():
    assert recall_by_depth(6000, sample=2000) >= 0.99


if __name__ == "__main__":
    recall_by_depth()
