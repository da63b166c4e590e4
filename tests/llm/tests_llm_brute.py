"""Plain versions that several test files use."""

import itertools


def words(text):
    return [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in (text or "")).split(" ") if w]


def brute_jaccard(rows, size, percent):
    """(id, shingles, least id of the group) of each row."""
    sets = []
    for _, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    return [(d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]
