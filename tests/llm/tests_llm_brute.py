"""Brute-force answers that several tests compare with."""


def components(rows, percent):
    """For each (id, text): number of shingles and smallest id of its component."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    best = {i: i for i in sets}

    def find(x):
        while best[x] != x:
            x = best[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                best[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
