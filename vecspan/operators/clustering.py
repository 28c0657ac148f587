"""Per-recording clustering and assignment: numpy kernels that Spark runs group by group.

A group is one recording (or one speaker), whose size the recording bounds; corpora are many groups.
"""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which spectral holds a matrix of all similarities.
DENSE_ROWS = 1024


def first_seen(labels: np.ndarray) -> np.ndarray:
    """Relabel in the order of first appearance; negative labels stay."""
    out, names = np.full(len(labels), -1), {}
    for i, x in enumerate(labels):
        if x >= 0:
            out[i] = names.setdefault(int(x), len(names))
    return out


def _kmeans(x: np.ndarray, k: int, seed: int = 0, starts: int = 10, steps: int = 100) -> np.ndarray:
    rng, best, best_cost = np.random.default_rng(seed), None, np.inf

    def apart(c: np.ndarray) -> np.ndarray:
        """Squared distances, centre by centre."""
        return np.stack([((x - y) ** 2).sum(-1) for y in c], axis=1)

    for _ in range(starts):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = apart(c).min(axis=1)
            c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(x))]])
        for _ in range(steps):
            lab = apart(c).argmin(axis=1)
            new = np.stack([x[lab == i].mean(axis=0) if (lab == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[lab]) ** 2).sum()
        if cost < best_cost:
            best, best_cost = lab, cost
    return best


def spectral(x: np.ndarray, num: int | None = None, least: int = 1, most: int = 20, seed: int = 0, dense: int = DENSE_ROWS) -> np.ndarray:
    """Cosine similarities in [0, 1], all but each row's largest set to 0 and those to 1, the unnormalised
    Laplacian's smallest eigenvectors by the largest eigengap, k-means. Two rows or fewer are one cluster.

    Over `dense` rows the neighbours go to a file and only the smallest eigenvectors are computed, so memory grows with the rows
    (time, and the file, with their square). If more than `most` parts of such a graph have no edge between them, all gaps are 0
    and `num` is `least`."""
    m = len(x)
    if m <= 2:
        return np.zeros(m, int)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    keep = max(1, m - (int(0.99 * m) if m >= 1000 else max(m - 10, 2)))
    wanted = max(most + 1, num or least)
    if m <= max(dense, 4 * wanted):
        sim = 0.5 * (1 + u @ u.T)
        order = np.argsort(-sim, axis=1, kind="stable")
        graph = np.zeros_like(sim)
        np.put_along_axis(graph, order[:, :keep], 1.0, axis=1)
        graph = 0.5 * (graph + graph.T)
        np.fill_diagonal(graph, 0)
        lap = np.diag(graph.sum(axis=1)) - graph
        w, v = np.linalg.eigh(lap)
    else:
        with _NeighbourGraph(u, keep) as graph:
            w, v = smallest_eigenpairs(graph.laplacian, graph.null_vectors(wanted), wanted, graph.widest, seed)
    if num is None:
        gaps = np.diff(w[: min(most + 1, m)])
        num = max(least, int(gaps.argmax()) + 1) if len(gaps) else 1
    return first_seen(_kmeans(v[:, :num], min(num, m), seed))


class _NeighbourGraph:
    """Each row's `keep` most similar rows (of equal ones the first) as a graph whose edges count half from either end.

    Similarities are computed for some rows at a time, and the neighbours are kept in a temporary file that every product reads
    in pieces.
    """

    def __init__(self, u: np.ndarray, keep: int, cells: int = 1 << 20) -> None:
        self.m, self.keep, self.step = len(u), keep, max(1, cells // len(u))
        self.file = tempfile.TemporaryFile()
        self.itself = np.zeros(self.m)
        ends = np.zeros(self.m)
        for lo in range(0, self.m, self.step):
            sim = 0.5 * (1 + u[lo : lo + self.step] @ u.T)
            least = np.partition(sim, self.m - keep, axis=1)[:, self.m - keep, None]
            near = sim > least
            ties = sim == least
            near |= ties & (np.cumsum(ties, axis=1, dtype=np.int32) <= keep - near.sum(axis=1, keepdims=True))
            to = np.nonzero(near)[1].astype(np.int32).reshape(len(sim), keep)
            to.tofile(self.file)
            self.itself[lo : lo + len(sim)] = near[np.arange(len(sim)), np.arange(lo, lo + len(sim))]
            ends += np.bincount(to.ravel(), minlength=self.m)
        self.file.flush()
        self.degree = 0.5 * (keep + ends) - self.itself
        #: No eigenvalue of the Laplacian is larger.
        self.widest = 2 * float(self.degree.max())

    def __enter__(self) -> _NeighbourGraph:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        """First row and neighbours of some rows at a time."""
        self.file.seek(0)
        step = max(1, (1 << 20) // self.keep)
        for lo in range(0, self.m, step):
            rows = min(step, self.m - lo)
            yield lo, np.fromfile(self.file, np.int32, rows * self.keep).reshape(rows, self.keep)

    def laplacian(self, x: np.ndarray) -> np.ndarray:
        """The Laplacian times x."""
        out = (self.degree + self.itself) * x
        for lo, to in self.pieces():
            hi = lo + len(to)
            out[lo:hi] -= 0.5 * x[to].sum(axis=1)
            out -= 0.5 * np.bincount(to.ravel(), np.repeat(x[lo:hi], self.keep), self.m)
        return out

    def null_vectors(self, most: int) -> np.ndarray:
        """Unit vectors of the graph's connected parts, the first rows' parts first, `most` at most."""
        part = np.arange(self.m)
        while True:
            before = part.copy()
            for lo, to in self.pieces():
                low = np.minimum(part[to].min(axis=1), part[lo : lo + len(to)])
                part[lo : lo + len(to)] = low
                np.minimum.at(part, to.ravel(), np.repeat(low, self.keep))
            part = part[part]
            if (part == before).all():
                break
        names = np.unique(part)[:most]
        out = (part[:, None] == names).astype(float)
        return out / np.sqrt(out.sum(axis=0))


def smallest_eigenpairs(product: Callable[[np.ndarray], np.ndarray], null: np.ndarray, k: int, widest: float, seed: int = 0, held: int = 160) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenvalues and vectors of a symmetric matrix without negative ones, by Lanczos with restarts.

    null has all its null vectors, or k of them. Pairs are found among what is orthogonal to those known. One start finds a
    repeated eigenvalue once, so starts anew follow until one finds nothing below the k-th.
    """
    rng, m = np.random.default_rng(seed), len(null)
    exact = 1e-11 * widest
    values, known = np.zeros(null.shape[1]), null
    while null.shape[1] < k and known.shape[1] < m:
        more = k - len(values)
        w, v = _lanczos(product, known, min(max(more, 1), m - known.shape[1]), exact, held, rng, values[k - 1] if more <= 0 else np.inf)
        if not len(w):
            break
        values, known = np.r_[values, w], np.hstack([known, v])
        order = np.argsort(values, kind="stable")
        values, known = values[order], known[:, order]
    return values[:k], known[:, :k]


def _lanczos(product: Callable, known: np.ndarray, k: int, exact: float, held: int, rng: np.random.Generator, below: float) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest pairs orthogonal to known, to residuals of `exact`; none if the smallest is certain not to be below `below`."""
    m = len(known)
    held = min(max(held, 4 * k), m - known.shape[1])
    basis, inner = np.empty((held, m)), np.zeros((held, held))

    def free(x: np.ndarray, n: int) -> np.ndarray:
        for _ in range(2):
            x = x - known @ (known.T @ x)
            x = x - basis[:n].T @ (basis[:n] @ x)
        return x

    def fresh(n: int) -> np.ndarray:
        x = free(rng.normal(size=m), n)
        return x / np.linalg.norm(x)

    n, x = 0, fresh(0)
    while True:
        basis[n] = x
        y = product(x)
        inner[: n + 1, n] = inner[n, : n + 1] = basis[: n + 1] @ y
        n += 1
        y = free(y, n)
        length = float(np.linalg.norm(y))
        ended = length <= exact
        if n == held or ended or n % 20 == 0:
            w, s = np.linalg.eigh(inner[:n, :n])
            off = np.zeros(n) if ended else np.abs(length * s[-1])
            # a start sees every eigenvalue but with tiny chance, so its smallest value is certain once its residual is small
            if n >= k and below < np.inf and off[0] <= max(1e-6 * below, exact) and w[0] >= below - max(1e-5 * below, exact):
                return w[:0], np.empty((m, 0))
            if n >= k and (off[:k] <= exact).all() or n == m - known.shape[1]:
                return w[:k], basis[:n].T @ s[:, :k]
            if n == held:
                n = min(held - 1, max(held // 2, 2 * k))
                basis[:n] = s[:, :n].T @ basis
                inner[:] = 0
                inner[np.arange(n), np.arange(n)] = w[:n]
        x = fresh(n) if ended else y / length


def average_linkage(dist: np.ndarray, threshold: float) -> np.ndarray:
    """Merge the closest clusters by mean distance while it is at most the threshold."""
    groups = [[i] for i in range(len(dist))]
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive = list(range(len(dist)))
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(sub.argmin()), len(alive))
        if sub[i, j] > threshold:
            break
        a, b = alive[min(i, j)], alive[max(i, j)]
        na, nb = len(groups[a]), len(groups[b])
        d[a] = d[:, a] = (na * d[a] + nb * d[b]) / (na + nb)
        d[a, a] = np.inf
        groups[a] += groups[b]
        alive.remove(b)
    out = np.empty(len(dist), int)
    for k, a in enumerate(alive):
        out[groups[a]] = k
    return first_seen(out)


def cosine_linkage(x: np.ndarray, threshold: float) -> np.ndarray:
    """average_linkage of 1 - (1 + cosine) / 2 by chains of nearest neighbours, without a matrix of distances.

    The mean cosine of two clusters is the product of their means. Two that are each other's nearest are merged whatever else
    is nearer elsewhere, which gives the same clusters, as merging brings none nearer to a third than its nearer half was; so one that
    has none within the threshold is done. Memory grows with the rows, time with their square.
    """
    n = len(x)
    mean = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    size, owner, place, joined = np.ones(n), np.arange(n), np.arange(n), np.arange(n)
    alive, chain = n, []

    def drop(k: int) -> None:
        nonlocal alive
        alive -= 1
        mean[k], size[k], owner[k] = mean[alive], size[alive], owner[alive]
        place[owner[k]] = k

    while alive:
        if not chain:
            chain.append(int(owner[0]))
        tip = place[chain[-1]]
        sim = mean[:alive] @ mean[tip]
        sim[tip] = -np.inf
        near = int(sim.argmax())
        before = place[chain[-2]] if len(chain) > 1 else None
        if before is not None and sim[before] >= sim[near] - 1e-12:
            near = before
        if not 1 - 0.5 * (1 + sim[near]) <= threshold:
            chain.pop()
            drop(tip)
        elif near == before:
            mean[near] = (size[near] * mean[near] + size[tip] * mean[tip]) / (size[near] + size[tip])
            size[near] += size[tip]
            joined[owner[tip]] = owner[near]
            del chain[-2:]
            drop(tip)
        else:
            chain.append(int(owner[near]))
    while (joined[joined] != joined).any():
        joined = joined[joined]
    return first_seen(joined)


def absorb_small(x: np.ndarray, labels: np.ndarray, merge: float = 0.3, smallest: int = 3, absorb: float = 0.0) -> np.ndarray:
    """Points without a cluster (-1) and what they form are merged, best mean cosine first, into others while
    it is at least `merge`; clusters below `smallest` go to the best large one if that is at least `absorb`."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    groups = [(np.flatnonzero(labels == k), True) for k in sorted(set(labels[labels >= 0].tolist()))] + [(np.array([i]), False) for i in np.flatnonzero(labels < 0)]
    while len(groups) > 1:
        sums = np.stack([u[g].sum(axis=0) for g, _ in groups])
        n = np.array([len(g) for g, _ in groups])
        sim = sums @ sums.T / (n[:, None] * n[None, :])
        fixed = np.array([f for _, f in groups])
        sim[np.logical_and.outer(fixed, fixed)] = -np.inf
        np.fill_diagonal(sim, -np.inf)
        i, j = divmod(int(sim.argmax()), len(groups))
        if sim[i, j] < merge:
            break
        merged = (np.r_[groups[i][0], groups[j][0]], groups[i][1] or groups[j][1])
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [merged]
    big = [g for g, _ in groups if len(g) >= smallest]
    out = np.full(len(x), -1)
    for k, g in enumerate(big):
        out[g] = k
    for k, (g, _) in enumerate(groups):
        if len(g) < smallest:
            score = [float((u[g].sum(axis=0) / len(g)) @ (u[b].sum(axis=0) / len(b))) for b in big]
            out[g] = int(np.argmax(score)) if score and max(score) >= absorb else len(big) + k
    return first_seen(out)


class OnlineClusters:
    """C6, ST2: a vector joins the best centroid at cosine >= threshold (running mean, unit length), else opens a
    new cluster while there are fewer than most, else joins the best."""

    def __init__(self, threshold: float = 0.5, most: int = 10, centroids: list | None = None, counts: list | None = None) -> None:
        self.threshold, self.most = threshold, most
        self.centroids = [np.asarray(c, float) for c in centroids or []]
        self.counts = list(counts or [])

    def add(self, v: np.ndarray) -> tuple[int, float]:
        v = np.asarray(v, float) / max(np.linalg.norm(v), 1e-12)
        if self.centroids:
            sims = np.stack(self.centroids) @ v
            k = int(sims.argmax())
            if sims[k] >= self.threshold or len(self.centroids) >= self.most:
                if sims[k] >= self.threshold:
                    c = (self.centroids[k] * self.counts[k] + v) / (self.counts[k] + 1)
                    self.centroids[k] = c / max(np.linalg.norm(c), 1e-12)
                    self.counts[k] += 1
                return k, float(sims[k])
        self.centroids.append(v)
        self.counts.append(1)
        return len(self.centroids) - 1, 1.0


def cluster_groups(df: DataFrame, group: str, key: str, method: str = "spectral", vec: str = "v", **options: object) -> DataFrame:
    """C1, C3 to C6 by recording: group, key, cluster. Rows are taken in the order of key."""
    kinds = dict(df.dtypes)

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(key)
        x = np.stack(pdf[vec]).astype(float)
        if method == "spectral":
            labels = spectral(x, **options)
        elif method == "linkage":
            labels = cosine_linkage(x, **options)
        elif method == "online":
            state = OnlineClusters(**options)
            labels = np.array([state.add(v)[0] for v in x])
        else:
            raise ValueError(f"unknown method {method}")
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": labels})

    return df.select(group, key, F.col(vec).cast("array<double>").alias(vec)).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster int")


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), one to one, of the largest total gain (shortest augmenting paths)."""
    cost = -np.asarray(gain, float)
    flip = cost.shape[0] > cost.shape[1]
    cost = cost.T if flip else cost
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            seen[j0] = True
            free = np.flatnonzero(~seen[1:]) + 1
            cur = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = cur < least[free]
            least[free[better]], way[free[better]] = cur[better], j0
            j1 = int(free[least[free].argmin()])
            delta = least[j1]
            u[match[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((j, i) for i, j in pairs) if flip else sorted(pairs)


def map_labels(overlaps: DataFrame, group: str, labels: DataFrame | None = None) -> DataFrame:
    """C7 by recording: group, label_a, mapped: label_a's partner label_b in the assignment of the largest total overlap.

    Pass the overlaps with the names to be replaced as label_a. labels (group, label_a) lists all of these: those
    without a partner or without any overlap keep their name. Without it only labels that overlap give a row.
    """
    kind = dict(overlaps.dtypes)[group]

    def run(pdf):
        import pandas as pd

        table = pdf.pivot_table(index="label_a", columns="label_b", values="overlap", aggfunc="sum", fill_value=0)
        pairs = {table.index[i]: table.columns[j] for i, j in best_assignment(table.to_numpy()) if table.iat[i, j] > 0}
        return pd.DataFrame([(pdf[group].iloc[0], a, pairs.get(a, a)) for a in table.index], columns=[group, "label_a", "mapped"])

    mapped = overlaps.groupBy(group).applyInPandas(run, f"{group} {kind}, label_a string, mapped string")
    if labels is None:
        return mapped
    return labels.select(group, "label_a").distinct().join(mapped, [group, "label_a"], "left").select(group, "label_a", F.coalesce("mapped", "label_a").alias("mapped"))


def balance_durations(durations: list[float], least: float, tolerance: float = 1e-5) -> list[tuple[int, int]]:
    """Neighbouring utterances joined into groups [start, end) of at least `least`, if there is enough.

    Groups too short wait on a stack. The one on top joins its left neighbour if that, or neither, is short of
    nothing; else the short one; with two short neighbours the shorter. A group of two joined ones waits again
    if it still is too short.
    """
    n = len(durations)
    begin, end, total = list(range(n)), list(range(1, n + 1)), list(durations)
    before, after, there = [i - 1 for i in range(n)], [*range(1, n), -1][:n], [True] * n  # neighbours; -1: none
    count = n
    short = lambda g: total[g] < least - tolerance
    waiting = [g for g in range(n) if short(g)]
    while waiting:
        g = waiting.pop()
        if not there[g] or count == 1:
            continue
        left, right = before[g], after[g]
        if left < 0 or right < 0:
            other = max(left, right)
        elif short(left) and short(right):
            other = left if total[left] <= total[right] + tolerance else right
        elif short(right):
            other = right
        else:
            other = left
        a, b = (other, g) if other == left else (g, other)
        # the joined group is a new one at the end of the lists
        new, count = len(begin), count - 1
        there[a] = there[b] = False
        for column, value in ((begin, begin[a]), (end, end[b]), (total, total[a] + total[b]), (before, before[a]), (after, after[b]), (there, True)):
            column.append(value)
        if before[new] >= 0:
            after[before[new]] = new
        if after[new] >= 0:
            before[after[new]] = new
        if short(new):
            waiting.append(new)
    return sorted((begin[g], end[g]) for g in range(len(begin)) if there[g])


def hold_filter(classes: list[int], hold: int = 75) -> list[int]:
    """The class stays until `hold` frames in a row have disagreed."""
    out, state, against = [], None, 0
    for c in classes:
        if state is None:
            state = c
        against = 0 if c == state else against + 1
        if against > hold:
            state, against = c, 0
        out.append(state)
    return out


def hysteresis(p: list[float], on: float = 0.5, off: float = 0.35, silence: int = 10, speech: int = 25, pad: int = 0, least: int = 0) -> list[tuple[int, int]]:
    """Frames [start, end) of speech.

    Speech begins at p >= on. A frame of p < off marks a possible end, which p >= on takes back; speech ends there as
    soon as another frame of p < off comes `silence` frames or more after it, and counts if it is longer than
    `speech`. Speech still open at the last frame lasts to the end, however short. Segments grow by `pad` on both sides
    and share a gap that is too small for it; those shorter than `least` are dropped last.
    """
    found: list[list[int]] = []
    start = end = None
    for i, x in enumerate(p):
        if x >= on:
            end = None
            start = i if start is None else start
        elif x < off and start is not None:
            end = i if end is None else end
            if i - end >= silence:
                if end - start > speech:
                    found.append([start, end])
                start = end = None
    if start is not None:
        found.append([start, len(p)])
    for left, right in zip(found, found[1:]):
        gap = right[0] - left[1]
        grow = gap // 2 if gap < 2 * pad else pad
        left[1], right[0] = left[1] + grow, max(0, right[0] - grow)
    if found:
        found[0][0], found[-1][1] = max(0, found[0][0] - pad), min(len(p), found[-1][1] + pad)
    return [(s, e) for s, e in found if e - s >= least]


def best_subset(sim: np.ndarray, size: int, closest: bool = True) -> tuple[int, ...]:
    """The members of largest (or smallest) total similarity among all of that size, of a small table."""
    score = lambda c: sum(sim[a, b] for a, b in itertools.combinations(c, 2))
    return (max if closest else min)(itertools.combinations(range(len(sim)), size), key=score)
